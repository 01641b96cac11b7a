"""Copy-quality rules over blocks of text: array<struct<kind, detail, key, placed>> of one block's faults.

detail quotes the words around the fault; key tells faults of a kind apart on one page, within their place
if placed.  All are Catalyst expressions.  Spark's regular expressions give the texts of matches and not
their positions, so a match carries what stands before and behind it: a look-behind and a look-ahead of
bounded length capture it, guarded by a look-ahead for the match itself, which fails fast elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.urls import let

# Fixed values.
TYPOS = (
    (r"\bvechicle\w*", "vehicle"),
    (r"\bvehical\w*", "vehicle"),
    (r"\bvehicel\w*", "vehicle"),
    (r"\bvehicule\w*", "vehicle"),
    (r"\btransportaion\b", "transportation"),
    (r"\btranspotation\b", "transportation"),
    (r"\btrasport\w*", "transport"),
    (r"\bshiping\b", "shipping"),
    (r"\bmotorcyle\w*", "motorcycle"),
    (r"\bmotercycl\w*", "motorcycle"),
    (r"\bmotorcylce\w*", "motorcycle"),
    (r"\bdelivary\b", "delivery"),
    (r"\brecieve\w*", "receive"),
    (r"\bseperate\w*", "separate"),
    (r"\boccured\b", "occurred"),
    (r"\boccurance\w*", "occurrence"),
    (r"\buntill\b", "until"),
    (r"\baccomodat\w*", "accommodate"),
    (r"\bguarentee\w*", "guarantee"),
    (r"\bgaurantee\w*", "guarantee"),
    (r"\bcustumer\w*", "customer"),
    (r"\bbuisness\w*", "business"),
    (r"\bdefinately\b", "definitely"),
    (r"\bneccessary\b", "necessary"),
    (r"\bnecesary\b", "necessary"),
    (r"\bproffesional\w*", "professional"),
    (r"\bprofesional\w*", "professional"),
    (r"\bexperiance\w*", "experience"),
    (r"\bconvinient\w*", "convenient"),
    (r"\bavailabe\b", "available"),
    (r"\bavaliable\b", "available"),
    (r"\baffordible\b", "affordable"),
    (r"\balot\b", "a lot"),
    (r"\bthankyou\b", "thank you"),
    (r"\bcancelation\b", "cancellation"),
    (r"\bmaintainance\b", "maintenance"),
    (r"\bsuccesful\w*", "successful"),
    (r"\bsucessful\w*", "successful"),
    (r"\bacheiv\w*", "achieve"),
    (r"\bbelive\b", "believe"),
    (r"\bcompetative\b", "competitive"),
    (r"\bqoute\w*", "quote"),
    (r"\bteh\b", "the"),
    (r"\bhastle\w*", "hassle"),
    (r"\binsurence\b", "insurance"),
    (r"\bliscense\w*", "license"),
    (r"\bregistartion\b", "registration"),
    (r"\bserivce\w*", "service"),
    (r"\bsevice\w*", "service"),
    (r"\bpiece of mind\b", "peace of mind"),
    (r"\byour welcome\b", "you're welcome"),
    (r"\bloose your\b", "lose your"),
    (r"\bwould of\b", "would have"),
    (r"\bcould of\b", "could have"),
    (r"\bshould of\b", "should have"),
    (r"\bless people\b", "fewer people"),
    (r"\bper say\b", "per se"),
    (r"\bfor all intensive purposes\b", "for all intents and purposes"),
)
PLACEHOLDERS = (
    (r"(?i)lorem ipsum", "Lorem ipsum filler text"),
    (r"(?i)dolor sit amet", "Lorem ipsum filler text"),
    (r"(?i)add your heading text here", "Elementor default heading placeholder"),
    (r"(?i)click edit button to change this text", "Elementor default text placeholder"),
    (r"(?i)this is the heading", "Page-builder default heading"),
    (r"(?i)insert your (content|text|image) here", "Unreplaced template placeholder"),
    (r"(?i)your (text|content) here", "Unreplaced template placeholder"),
    (r"(?i)sample (text|page|heading|content)", "Sample content left in place"),
    (r"(?i)\bplaceholder text\b", "Literal 'placeholder text' in copy"),
    (r"(?<![A-Za-z0-9])TBD(?![A-Za-z0-9])", "'TBD' left in copy"),
    (r"(?<![A-Za-z0-9])TODO(?![A-Za-z0-9])", "'TODO' left in copy"),
    (r"(?<![A-Za-z0-9])FIXME(?![A-Za-z0-9])", "'FIXME' left in copy"),
    (r"(?i)\bcoming soon\b", "'Coming soon' stub"),
    (r"(?<![A-Za-z0-9])XXX+(?![A-Za-z0-9])", "'XXX' placeholder"),
    (r"(?i)\bdummy (text|content)\b", "Dummy content"),
    (r"(?i)\[your [a-z ]{2,20}\]", "Unfilled merge field"),
    (r"\{\{[^}]{1,40}\}\}", "Unrendered template token"),
    (r"%[A-Z_]{3,}%", "Unrendered template token"),
    (r"\bundefined\b", "Literal 'undefined' rendered into copy"),
    (r"\bNaN\b", "Literal 'NaN' rendered into copy"),
    (r"\[object Object\]", "Literal '[object Object]' rendered into copy"),
    (r"(?i)\berror:? ?undefined\b", "Error text rendered into copy"),
)
MOJIBAKE = ("â€™", "â€œ", "â€", "â€“", "â€”", "â€¦", "Ã©", "Ã¡", "Ã±", "ï¿½", "�")
ENTITY = r"&(?:nbsp|amp|quot|apos|lt|gt|ndash|mdash|hellip|#\d{2,5}|#x[0-9a-fA-F]{2,5});"
DOUBLED = r"(?U)(?<![-'’\w])(\p{L}{2,}+)\s++\1(?![-'’\w])"
DOUBLED_FINE = ("had", "that", "very", "no", "ha", "yes")
SPACE_BEFORE = r"\S\s+[,.;:!?](?:\s|$)"
MISSING_SPACE = rf"[a-z]{{2}}[.,;!?](?<!{ENTITY})[A-Z][a-zA-Z]*"
NOT_A_SENTENCE = "com net org io co gov edu us uk ca info biz tv ai app dev png jpg jpeg webp svg gif pdf zip csv html php js css xml json mp4".split()

SIGNAL = "array<struct<kind: string, detail: string, key: string, placed: boolean>>"
#: Characters that are quoted on either side of a fault.
PAD = 34


def _signal(kind: str, detail: Column, key: Column, placed: bool = True) -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), key.alias("key"), F.lit(placed).alias("placed"))


def _signals(kind: str, details: Column) -> Column:
    return F.transform(F.array_distinct(details), lambda d: _signal(kind, d, d))


def _once(kind: str, found: Column, detail: Column, text: Column, rule: str) -> Column:
    """One fault a block; blocks of a place that begin alike are one."""
    return F.when(found, F.array(_signal(kind, detail, F.concat(F.lit(f"{rule}:"), F.substring(text, 1, 30))))).otherwise(F.array().cast(SIGNAL))


def matches_around(text: Column, pattern: str, guard: str) -> Column:
    """array<struct<match, around, first>> of a pattern without groups: what matched, with up to PAD characters
    on either side and an ellipsis where the text goes on, and whether it begins the text.  guard: what a match
    has to begin with, cheap to test.  What stands before is looked up last, behind the match itself."""
    whole = rf"(?s)(?={guard})(?={pattern})(?<=(^.{{0,{PAD}}}|.{{{PAD + 1}}}))({pattern})(?=(.{{0,{PAD + 1}}}))"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(whole), F.lit(i)).alias(c) for i, c in ((1, "before"), (2, "match"), (3, "behind"))])

    def made(m: Column) -> Column:
        lead = F.when(F.length(m.before) > PAD, F.substring(m.before, 2, PAD)).otherwise(m.before)
        trail = F.when(F.length(m.behind) > PAD, F.substring(m.behind, 1, PAD)).otherwise(m.behind)
        dots = [F.when(F.length(x) > PAD, F.lit("\u2026")).otherwise(F.lit("")) for x in (m.before, m.behind)]
        return F.struct(m.match.alias("match"), F.concat(dots[0], F.trim(F.concat(lead, m.match, trail)), dots[1]).alias("around"), (m.before == "").alias("first"))

    return F.when(text.rlike(guard), F.transform(parts, made)).otherwise(F.array().cast("array<struct<match: string, around: string, first: boolean>>"))


def _quoted(label: str, what: Column) -> Column:
    return F.concat(F.lit(f"{label}\u201c"), what, F.lit("\u201d"))


def _by_first_letter(patterns: list[str]) -> str:
    """One search for patterns that begin at a word: at each word only those of its first letter are tried."""
    letters: dict[str, list[str]] = {}
    for p in patterns:
        letters.setdefault(p[2], []).append(p[3:])
    return r"\b(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(letters.items())) + ")"


def misspellings(text: Column) -> Column:
    """One signal per pattern that is found, with its correction.  One alternation over all patterns
    goes first, so a text without any pays for a single search."""

    def hits(low: Column) -> Column:
        found = F.filter(F.array(*[F.when(low.rlike(p), F.concat(F.regexp_extract(low, p, 0), F.lit(f" -> {fix}"))) for p, fix in TYPOS]), lambda x: x.isNotNull())
        return F.when(low.rlike(_by_first_letter([p for p, _ in TYPOS])), _signals("misspelling", found)).otherwise(F.array().cast(SIGNAL))

    return let(F.lower(text), hits)


#: What a text holds if a placeholder pattern is to match it: in lower case for patterns of any case, as written for
#: the others.
PLACEHOLDER_HINTS = ("lorem ipsum", "dolor sit amet", "add your heading", "click edit button", "this is the heading", "insert your ", "your ", "sample ", "placeholder text", "TBD", "TODO", "FIXME", "coming soon", "XXX", "dummy ", "[your ", "{{", "%", "undefined", "NaN", "[object Object]", "error")


def placeholders(text: Column, runs: Column | None = None) -> Column:
    """Markers, which have a case of their own, are looked for in the runs joined by blanks, so that neighbouring
    elements make up none; filler of any case in the text as it shows.  A pattern is tried where its hint stands."""
    spaced = text if runs is None else F.when((F.size(runs) == 1) & ~text.rlike(r"\s\s|[^\S ]"), text).otherwise(F.trim(F.regexp_replace(F.array_join(runs, " "), r"\s+", " ")))

    def hit(t: Column, pattern: str, hint: str, label: str) -> Column:
        prose = pattern.startswith("(?i)")
        return F.when((t.low if prose else t.spaced).contains(hint), F.when((t.text if prose else t.spaced).rlike(pattern), F.lit(label)))

    def hits(t: Column) -> Column:
        return F.filter(F.array(*[hit(t, p, hint, label) for (p, label), hint in zip(PLACEHOLDERS, PLACEHOLDER_HINTS, strict=True)]), lambda x: x.isNotNull())

    return _signals("placeholder", let(F.struct(text.alias("text"), F.lower(text).alias("low"), spaced.alias("spaced")), hits))


def mojibake(raw: Column) -> Column:
    """One signal per damaged sequence, with how often it occurs."""
    hits = F.filter(F.array(*[F.when(raw.contains(m), F.concat(F.lit(f"{m} x "), ((F.length(raw) - F.length(F.replace(raw, F.lit(m), F.lit("")))) / len(m)).cast("long").cast("string"))) for m in MOJIBAKE]), lambda x: x.isNotNull())
    return _signals("mojibake", hits)


def entities(text: Column) -> Column:
    """The first entity that reached the text."""
    return let(matches_around(text, ENTITY, "&"), lambda found: _once("entity", F.size(found) > 0, _quoted("HTML entity left in the text: ", F.try_element_at(found, F.lit(1)).around), text, "ent"))


def doubled_words(text: Column) -> Column:
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(DOUBLED), F.lit(1)), lambda w: ~w.isin(*DOUBLED_FINE))
    return _signals("doubled-word", found)


def adjacency_slips(runs: Column) -> Column:
    """Marks with a space before them and without one behind them, within one run: whether the boundary of two
    runs shows as a space is up to the style sheet.  Hosts, file names and the end of a literal entity are no
    ends of sentences."""

    def of_run(run: Column) -> Column:
        before = F.filter(matches_around(run, r"\s+[,.;:!?](?:\s|$)", r"\s[\s,.;:!?]"), lambda m: ~m.first)
        missing = F.filter(matches_around(run, MISSING_SPACE, r"[a-z]{2}[.,;!?][A-Z]"), lambda m: ~F.lower(F.substring(m.match, 4, 100)).isin(*NOT_A_SENTENCE))
        return F.concat(
            F.transform(before, lambda m: _signal("punctuation", _quoted("Space before a punctuation mark: ", m.around), F.concat(F.lit("sp:"), m.around), False)),
            F.transform(missing, lambda m: _signal("punctuation", _quoted("Missing space after punctuation: ", m.match), F.concat(F.lit("ns:"), m.match), False)),
        )

    worth = F.filter(runs, lambda r: r.rlike(r"\s[,.;:!?]|[a-z]{2}[.,;!?][A-Z]"))
    return F.array_distinct(F.flatten(F.transform(worth, of_run)))


def punctuation(text: Column, runs: Column | None = None) -> Column:
    own = F.trim(text)
    double = let(matches_around(own, r"(?<=\S) {2,}(?=\S)", "  "), lambda found: _once("punctuation", F.size(found) > 0, _quoted("Double space inside a sentence: ", F.try_element_at(found, F.lit(1)).around), text, "ds"))
    opened, closed = (F.regexp_count(text, F.lit(p)) for p in (r"\(", r"\)"))
    odd = F.when(opened > closed, F.try_element_at(matches_around(text, r"\(", r"\("), F.lit(1))).otherwise(F.try_element_at(matches_around(text, r"\)", r"\)"), F.lit(1)))
    lopsided = _once("punctuation", opened != closed, _quoted("Unbalanced parentheses: ", odd.around), text, "par")
    return F.concat(adjacency_slips(F.array(text) if runs is None else runs), double, lopsided)


def capitals(text: Column) -> Column:
    return _once("style", ~text.rlike("[a-z]") & (F.length(F.regexp_replace(text, "[^A-Z]", "")) > 25), F.lit("Sentence set entirely in capitals"), text, "caps")


def copy_signals(text: Column, runs: Column | None = None) -> Column:
    """All faults of one block.  runs: its text nodes, which bound some rules; the text is one run without them.
    Damaged characters are looked for by itself, as a page's are in its source."""
    return F.concat(misspellings(text), placeholders(text, runs), entities(text), doubled_words(text), punctuation(text, runs), capitals(text))
