"""Personal data, and terms that give it away, by corpus co-occurrence (operator 12).

Everything here is DataFrame functions: patterns, positions and statistics stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanwarden.llm.shared import written

# ---- fixed values: kinds in their order, and what they look like -------------------------------
# Starts are anchored and repeats possessive, so that a long run of letters or digits is read once; the matches are those of
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+ and
# \+[0-9][\x20().0-9-]+[0-9].

PATTERNS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
_MARKS = " ().+-"

#: A term: a run of at least three letters or digits. A context: a sentence or line, cut after every 64 words.
TERM = r"[\p{L}\p{N}]{3,}+"
_SENTENCE = r"\n|(?<=[.!?])\x20"
_WORDS_64 = r"((?:(?<!\S)\S++\s++){64})"
#: Letters that a generalised term keeps.
STEM = 4

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``join`` makes of all earlier ones; in blocks of about the root of the size, so that n elements
    take n * sqrt(n) steps in the row itself."""
    def fold(some: Column, start: Column = zero) -> Column:
        return F.aggregate(some, start, join)

    def blocks(size: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size))
        return _let(cut, lambda parts: _let(F.transform(parts, lambda x: fold(x)), lambda sums: F.flatten(F.transform(
            parts, lambda x, k: _let(fold(F.slice(sums, 1, k)), lambda start: F.transform(x, lambda _, i: fold(F.slice(x, 1, i), start)))))))

    return F.when(F.size(values) > 0, _let(F.ceil(F.sqrt(F.size(values))).cast("int"), blocks)).otherwise(F.array().cast("array<int>"))


def _digits(match: Column) -> Column:
    return F.translate(match, _MARKS, "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every other one from the right doubled, add up to a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(digits.substr(n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return _let(_digits(match), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """One spelling for an entity."""
    return F.lower(match) if kind == "email" else _digits(match) if kind in ("card", "phone") else match


def _places(text: Column, pattern: str, matches: Column, kind: int, value: Callable[[Column], Column] = lambda m: m) -> Column:
    """Spans of the matches of ``pattern``: what stands between them gives their places, in code points."""
    def placed(found: Column) -> Column:
        def from_gaps(gaps: Column) -> Column:
            steps = F.zip_with(found, gaps, lambda m, g: F.length(m) + g)
            starts = _let(steps, lambda s: _before(s, F.lit(0), lambda a, b: a + b))
            at = F.zip_with(starts, gaps, lambda s, g: s + g)
            return F.zip_with(found, at, lambda m, s: F.struct(
                s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), value(m).alias("value")))
        gaps = F.slice(F.transform(F.split(text, pattern), lambda g: F.length(g)), 1, F.size(found))
        return _let(gaps, from_gaps)
    return F.when(F.size(matches) > 0, _let(matches, placed)).otherwise(F.array()).cast(_SPAN)


def _find(rows: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the column ``into`` with the personal data of the column ``text``, ordered by start and kind."""
    rows = rows.withColumns({f"_m_{into}_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})

    def valid(number: int, kind: str) -> Column:
        return F.filter(_places(F.col(text), PATTERNS[kind], F.col(f"_m_{into}_{kind}"), number), lambda s: _holds(kind, s["value"]))

    every = [valid(i, k) for i, k in enumerate(PATTERNS)]
    named = F.transform(F.sort_array(F.concat(*every)), lambda s: s.withField("value", F.coalesce(
        *[F.when(s["kind"] == i, _value(k, s["value"])) for i, k in enumerate(PATTERNS)])))
    return rows.withColumn(into, named.cast(_SPAN)).drop(*[f"_m_{into}_{k}" for k in PATTERNS])


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def contexts(text: Column) -> Column:
    """Sentences and lines of a text, cut after every 64 words."""
    sentences = F.filter(F.split(text, _SENTENCE), lambda s: F.length(s) > 0)
    return F.flatten(F.transform(sentences, lambda s: F.split(F.regexp_replace(s, _WORDS_64, "$1\n"), "\n")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def disclosing_terms(docs: DataFrame, holders: DataFrame, disclosure: float = 0.9, least_contexts: int = 5, text: str = "text") -> DataFrame:
    """``entity``, ``term``, ``n_both``, ``n_term``, ``n_entity``, ``disclosed`` and ``general``: terms that give an entity away.

    Probabilities are shares of the corpus's distinct contexts (``contexts``), so copies count once. An entity e has log2 1 / p(e) bits;
    a term t gives away log2 p(e, t) / (p(e) p(t)) of them. Terms that give away the share ``disclosure`` or more,
    and stand beside the entity in ``least_contexts`` contexts or more, are returned, with what they are generalised to: their
    first letters if all words that begin so together give away less, else nothing. ``holders`` are the rows of ``docs`` with personal data.
    """
    seen = holders.select(F.explode(contexts(F.col(text))).alias("context")).where(F.col("context").rlike("[@0-9]"))
    seen = _find(seen, "context", "spans").where(F.size("spans") > 0)
    bare = _replaced(F.col("context"), F.col("spans"), [" "] * len(KINDS))
    names = F.array(*map(F.lit, KINDS))
    seen = seen.select(F.md5("context").alias("h"), _terms(bare).alias("terms"), F.array_distinct(
        F.transform("spans", lambda s: F.concat_ws(":", names[s["kind"]], s["value"]))).alias("entities"))
    seen = written(seen.dropDuplicates(["h"]))
    n_entity = seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # a context has at most 64 words, so its pairs are bounded
    both = seen.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    both = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    # equal contexts are dropped before their words are counted; the empty term counts the contexts themselves
    every = docs.select(F.explode(contexts(F.col(text))).alias("context")).distinct()
    words = every.select(F.explode(F.concat(F.array(F.lit("")), _terms(F.col("context")))).alias("term"))
    n_term = written(words.groupBy("term").agg(F.count("*").alias("n_term")))
    first = n_term.where(F.col("term") == "").first()
    total = float(first["n_term"] if first else 0)
    bits = F.log2(F.lit(total + 1) / F.col("n_entity"))

    def share(of_all: str, beside: str) -> Column:
        return 1 - F.log2(F.col(of_all) / F.col(beside)) / bits

    found = both.where(F.col("n_both") >= least_contexts).join(n_entity, "entity").join(n_term, "term")
    found = found.withColumn("disclosed", share("n_term", "n_both")).where(F.col("disclosed") >= disclosure)
    # the same for all words with the stem together, counted by (word, context)
    by_stem = n_term.groupBy(_stem(F.col("term")).alias("stem")).agg(F.sum("n_term").alias("stem_term"))
    stem_both = both.groupBy("entity", _stem(F.col("term")).alias("stem")).agg(F.sum("n_both").alias("stem_both"))
    found = found.withColumn("stem", _stem(F.col("term"))).join(by_stem, "stem").join(stem_both, ["entity", "stem"])
    less = share("stem_term", "stem_both") < disclosure
    shorter = F.length("term") > STEM
    return found.select("entity", "term", "n_both", "n_term", "n_entity", "disclosed", F.when(less & shorter, F.col("stem")).otherwise("").alias("general"))


def sanitised(docs: DataFrame, ident: str = "doc_id", text: str = "text", disclosure: float = 0.9, least_contexts: int = 5) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, kind, end and value in code points; kind by its place in ``KINDS``) and
    ``text``, for each row of ``docs``.

    ``base`` has what the patterns find in the whole text; ``spans`` adds the terms that give away an entity of the same document
    (``disclosing_terms``) wherever they stand outside it. In ``text`` personal data becomes ``<KIND>`` and a term what it is
    generalised to. A null text counts as empty; rows that repeat or share an id are taken each; texts may be of any
    length; an empty table gives no rows; other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = _find(docs.select(F.col(ident).alias("doc_id"), body.alias("text")), "text", "base")
    rows = written(rows.withColumn("row", F.when(F.size("base") > 0, F.monotonically_increasing_id())))
    holders, clean = rows.where(F.col("row").isNotNull()), rows.where(F.col("row").isNull())
    names = F.array(*map(F.lit, KINDS))
    terms = written(disclosing_terms(rows, holders, disclosure, least_contexts).select("entity", "term", "general"))
    entity = F.explode(F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", names[s["kind"]], s["value"]))))
    told = holders.select("row", entity.alias("entity")).join(terms, "entity").groupBy("row", "term").agg(F.max("general").alias("general"))
    words = holders.select("row", F.explode(_terms(F.col("text"))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    # of a document's words those that give away one of its own entities: at most its distinct words
    held = words.join(told, ["row", "term"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "general"))).alias("held"))
    with_terms = holders.join(held, "row", "left")
    matches = F.when(F.col("held").isNotNull(), F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).otherwise(F.array().cast("array<string>"))
    with_terms = with_terms.withColumn("words", matches)
    added = _places(F.col("text"), TERM, F.col("words"), len(PATTERNS), lambda m: F.col("held")[F.lower(m)])
    outside = F.filter(added, lambda w: w["value"].isNotNull() & ~F.exists("base", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    with_terms = with_terms.withColumn("spans", F.sort_array(F.concat("base", outside)))
    with_terms = with_terms.select("doc_id", "base", "spans", _replaced(F.col("text"), F.col("spans"), [f"<{k.upper()}>" for k in KINDS]).alias("text"))
    return with_terms.union(clean.select("doc_id", "base", F.col("base").alias("spans"), "text"))


def _replaced(text: Column, spans: Column, labels: Sequence[str]) -> Column:
    """The text with a label for each span, by kind, and what it is generalised to for a term; of spans that overlap the first
    has the label, and nothing of the others is left."""
    labels = F.array(*map(F.lit, labels))

    def put(done: Column) -> Column:
        pieces = F.zip_with(spans, done, lambda s, e: F.concat(
            text.substr(e + 1, F.greatest(s["start"] - e, F.lit(0))),
            F.when(s["start"] < e, "").when(s["kind"] == len(PATTERNS), s["value"]).otherwise(labels[s["kind"]])))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), text.substr(last + 1, F.length(text)))
    ends = _let(F.transform(spans, lambda s: s["end"]), lambda e: _before(e, F.lit(0), lambda a, b: F.greatest(a, b)))
    return _let(ends, put)
