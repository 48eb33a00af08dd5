"""Personal data: exact patterns for entities, and terms that reveal entities, by corpus co-occurrence.

Everything is made of DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blank_null, join_small, materialize, release
from tessella.llm.exact import normal_text
from tessella.operators.ranges import unit_join

#: Patterns of the base kinds, in the order of results. Quantifiers are possessive where that changes no match, and a
#: match of emails and addresses starts at a run's start or where the last match ended, so long runs cost linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A word: a run of letters, figures and marks with a letter in it, as it stands in the text; what is counted and compared is its lower case.
HELD = r"[\p{L}\p{N}\p{M}]"
#: What of words may be a term: three characters, any number in scripts without case, or two letters with a capital.
TERM = r"^(?:.{3,}|[\p{Lo}\p{M}]+|\p{Lu}\p{L})$"
#: The class of all protected entities, beside the classes of each kind.
ANY = "any"
#: Terms and entities of one text that meet in one unit of a task's work.
PAIRED = 2000
_SPANS = "array<struct<start:int,stop:int,match:string>>"


def spans(text: str, pattern: Column | str) -> Column:
    """All matches in a text column, leftmost and without overlap: start and stop in code points, and the string.

    Positions are running sums over the pieces between matches and the matches. They are folded by 256 at a time, so a
    text with many matches doesn't copy a growing list for each.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("m"), F.split(F.col(text), pattern, -1).alias("g"))

    def one(b: Column, state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(b["g"], i))
        stop = start + F.length(F.get(b["m"], i))
        return F.struct(stop.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), stop.alias("stop"), F.get(b["m"], i).alias("match"))).alias("out"))

    def some(b: Column, state: Column, c: Column) -> Column:
        upto = F.least(c * 256 + 255, F.size(b["m"]) - 1)
        part = F.aggregate(F.sequence(c * 256, upto), F.struct(state["at"].alias("at"), F.array().cast(_SPANS).alias("out")), lambda s, i: one(b, s, i))
        joined = F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.array_append(state["out"], p["out"]).alias("out")))
        return F.get(joined, F.lit(0))

    def all_of(b: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(b["m"]) - 1) / 256).cast("int"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
        return F.when(F.size(b["m"]) > 0, F.flatten(F.aggregate(chunks, zero, lambda s, c: some(b, s, c))["out"]))

    return F.coalesce(F.get(F.transform(F.array(both), all_of), F.lit(0)), F.array().cast(_SPANS))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled (less 9 above 9), the sum a multiple of 10."""
    figures = F.transform(F.reverse(F.split(_digits(match), "")), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(figures, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    size = F.length(_digits(match))
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda span: _VALID[kind](span["match"])


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda span: F.concat_ws(":", F.lit(kind), span["start"].cast("string"), span["stop"].cast("string"))


def _tagged(kind: str) -> Callable[[Column], Column]:
    return lambda span: F.struct(span["start"].alias("start"), span["stop"].alias("stop"), F.lit(f"[{kind.upper()}]").alias("tag"))


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with a column for each kind, named _email and so on: the spans that pass the kind's check."""
    figures = F.col(text).rlike("[0-9]")
    for kind, pattern in PATTERNS.items():
        may = F.lit(True) if kind == "email" else figures
        may = may if _HINTS[kind] is None else may & F.col(text).contains(_HINTS[kind])
        found = F.when(may, F.filter(spans(text, pattern), _passes(kind)))
        docs = docs.withColumn(f"_{kind}", F.coalesce(found, F.array().cast(_SPANS)))
    return docs


def _distinct_texts(texts: DataFrame) -> tuple[DataFrame, int]:
    """key, text: one of each normalised text (the least of its copies), and their number."""
    keyed = texts.select("text", F.unhex(F.md5(normal_text("text"))).alias("key"))
    keys = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")), "pii-keys")
    repeated = keys.filter("n > 1").select("key")
    copied = join_small(keyed, repeated, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    return join_small(keyed, repeated, "key", "left_anti").select("key", "text").unionByName(copied), keys.count()


def _words(text: Column, like: str | None = None) -> Column:
    """The distinct words of a text in lower case; only those that are like a pattern as they stand, if there is one."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(HELD + "++"), F.lit(0))), lambda w: w.rlike(r"\p{L}"))
    return F.array_distinct(F.transform(found if like is None else F.filter(found, lambda w: w.rlike(like)), F.lower))


def _assured(k: Column, n: Column, sure: float) -> Column:
    """The lower end of Wilson's interval of a share k / n, `sure` standard deviations wide."""
    z = sure * sure
    p = k / n
    return (p + z / (2 * n) - sure * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def revealing_terms(texts: DataFrame, support: int, share: float, bits: float, class_share: float = 0.3, class_bits: float = 2.0, sure: float = 3.0) -> DataFrame:
    """term: words that reveal an entity, or that some entity of a class stands there. texts: all texts (column text).

    All counts are of distinct normalised texts, so copies count once. Let n(t, e) be the number of those that hold the term t
    (outside e-mail addresses) and the entity e, wherever they stand, n(t) and n(e) of those that hold either, N of all. The
    term reveals e if n(t, e) >= support, n(t, e) / n(t) >= share, and log2(n(t, e) N / (n(t) n(e))) >= bits.

    Classes are the kinds and all of them together; e is then any entity of the class. As these are frequent, chance is
    guarded against by the lower end L of the share's interval (`sure` standard deviations): the term reveals the class if
    n(t, e) >= support, L >= class_share and log2(L N / n(e)) >= class_bits.

    As n(t, e) is at most n(t) and n(e), only terms and entities of at least `support` texts can pass, entities only up to
    N / 2^bits texts, terms only with n(t) times the share at most n(e). So others are left out before terms meet entities.
    """
    once, total = _distinct_texts(texts)
    most = total / 2**bits
    plain = F.when(F.col("text").contains("@"), F.regexp_replace("text", PATTERNS["email"], " ")).otherwise(F.col("text"))
    entities = F.array_distinct(F.transform(F.concat(*(F.col(f"_{k}") for k in PATTERNS)), lambda s: F.lower(s["match"])))
    terms = _words(plain, TERM)
    classes = F.array_compact(F.array(F.lit(ANY), *(F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in PATTERNS)))
    some = base_spans(once.filter(F.col("text").rlike("[0-9@]")), "text").filter(" OR ".join(f"size(_{k}) > 0" for k in PATTERNS))
    held = materialize(some.select("key", entities.alias("entities"), classes.alias("classes"), terms.alias("terms")), "pii-held")

    named = held.select("key", F.explode("entities").alias("entity"))
    often = named.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e").between(support, most))
    often = materialize(often, "pii-entities")
    largest = often.agg(F.max("n_e")).first()[0] or 0
    sizes = {r["class"]: r["n"] for r in held.select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n")).collect()}
    # Counted before anything is joined, so that words meet within each task first.
    counts = once.select(F.explode(_words(plain)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    by_entity, by_class = (F.col("n_t") <= most) & (F.col("n_t") * share <= largest), F.col("n_t") * class_share <= sizes.get(ANY, 0)
    counts = materialize(counts.filter((F.col("n_t") >= support) & (by_entity | by_class)), "pii-terms")
    near = held.select("key", "classes", F.explode("terms").alias("term")).join(counts.hint("merge"), "term")
    near = materialize(near, "pii-near")

    n_te = F.col("n_te")
    # A text of many terms and many entities is cut into units of bounded size.
    entities = materialize(join_small(named, often, "entity", "inner"), "pii-named")
    pairs = unit_join(near.filter(by_entity).select("key", "term", "n_t"), entities, ["key"], PAIRED).filter(F.col("n_t") * share <= F.col("n_e"))
    pairs = pairs.groupBy("entity", "term", "n_t", "n_e").agg(F.count("*").alias("n_te")).filter(n_te >= support)
    chance = n_te / F.col("n_t")
    found = pairs.filter((chance >= share) & (F.log2(chance * total / F.col("n_e")) >= bits)).select("term")
    with_class = near.groupBy("term", "n_t").agg(*(F.count_if(F.array_contains("classes", c)).alias(f"n_{c}") for c in (*PATTERNS, ANY)))

    def reveals(c: str) -> Column:
        least = _assured(F.col(f"n_{c}"), F.col("n_t"), sure)
        return (F.col(f"n_{c}") >= support) & (least >= class_share) & (F.log2(least * total / sizes[c]) >= class_bits)

    telling = [reveals(c) for c in sizes]
    if telling:
        found = found.unionByName(with_class.filter(F.greatest(*telling, F.lit(False))).select("term"))
    out = materialize(found.distinct(), "pii-revealing")
    release(held, often, counts, near, entities)
    return out


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, share: float = 0.5, bits: float = 6.0,
    class_share: float = 0.3, class_bits: float = 2.0, sure: float = 3.0,
) -> DataFrame:
    """One row per document: row_id, text, email, ip, card, phone, term (span arrays: start, stop in code points, match).

    The base kinds are found by their patterns and checks; `term` holds words that reveal a protected entity (see
    revealing_terms), wherever they stand. A null text counts as empty. Ids may be null or repeat; an empty table gives no
    row; other columns of docs don't matter.
    """
    plain = docs.select(F.col(id_col).alias("row_id"), blank_null(F.col(text_col)).alias("text"))
    based = base_spans(plain, "text")
    terms = revealing_terms(plain, support, share, bits, class_share, class_bits, sure)
    out = based.withColumn("_words", F.lit(None).cast("array<string>"))
    if not terms.isEmpty():
        words = plain.select(F.xxhash64("text").alias("h"), F.explode(_words(F.col("text"))).alias("term"))
        words = join_small(words, terms, "term", "inner").distinct().groupBy("h").agg(F.collect_list("term").alias("_words"))
        words = materialize(words, "pii-words")
        out = join_small(based.withColumn("h", F.xxhash64("text")), words, "h", "left")
    located = F.filter(spans("text", HELD + "++"), lambda s: F.array_contains("_words", F.lower(s["match"])))
    out = out.withColumn("_term", F.when(F.col("_words").isNotNull(), located))
    return out.select("row_id", "text", *(F.col(f"_{k}").alias(k) for k in PATTERNS), F.coalesce("_term", F.array().cast(_SPANS)).alias("term"))


def listed(kinds: list[str]) -> Column:
    """kind:start:stop of all spans, by kind as listed, then start, joined by commas."""
    return F.array_join(F.concat(*(F.transform(F.col(k), _named(k)) for k in kinds)), ",")


def sanitise(found: DataFrame) -> DataFrame:
    """row_id, clean_text: base entities replaced by their kind in brackets, revealing terms generalised to [TERM].

    Overlapping spans merge; the earliest one's kind stands for all.
    """
    tagged = [F.transform(F.col(k), _tagged(k)) for k in (*PATTERNS, "term")]
    ordered = F.array_sort(F.concat(*tagged))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])
        new = F.struct(x["stop"].alias("at"), F.concat(s["out"], gap, x["tag"]).alias("out"))
        within = F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] >= s["at"], new).otherwise(within)

    return found.select("row_id", F.aggregate(ordered, state, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))).alias("clean_text"))
