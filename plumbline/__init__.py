"""Website audits as Spark jobs: pages and measurements in, signals, findings and scores out."""
