"""Text tables: segments, sentences, mentions, issue labels, snippets."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.ranges import Stretches, by_key_size, small_join
from tessella.operators.vocabulary import with_hits, with_terms
from tessella.sources.scratch import settled


#: Elements of HTML without content: they are over where they start.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _SpeechText(HTMLParser):
    """Text of a page by owner: each speech has a number from 1, 0 owns what is outside all of them.

    `path` holds the open elements with the owner of the text in them. An end tag closes the nearest element of its name
    and all that was left open inside it; one without a start does nothing. What a page leaves open ends with the page.
    """

    def __init__(self, element: str) -> None:
        super().__init__(convert_charrefs=True)
        self.element, self.path = element, [("", 0)]
        self.kinds: list[str | None] = [None]
        self.said: list[list[str]] = [[]]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        owner = self.path[-1][1]
        if tag in VOID:
            self.said[owner].append("\n")
            return
        if tag == self.element:
            owner = len(self.kinds)
            self.kinds.append(dict(attrs).get("class"))
            self.said.append([])
        self.path.append((tag, owner))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.said[self.path[-1][1]].append("\n")

    def handle_endtag(self, tag: str) -> None:
        opened = max((i for i, (name, _) in enumerate(self.path) if name == tag), default=0)
        if opened:
            del self.path[opened:]

    def handle_data(self, data: str) -> None:
        self.said[self.path[-1][1]].append(data)

    @classmethod
    def read(cls, markup: str, element: str) -> tuple[str, list[dict]]:
        page = cls(element)
        page.feed(markup)
        page.close()
        outside, *speeches = map("".join, page.said)
        return outside, [{"kind": k, "text": t} for k, t in zip(page.kinds[1:], speeches, strict=True)]


def html_segments(pages: DataFrame, id_col: str, html_col: str, element: str = "spk", shortest: int = 12) -> DataFrame:
    """id, ordinal, segment_type, speaker_class, text: a row for each speech and for each paragraph outside them (those come first).

    A speech inside a speech has its own row. Void and unclosed elements lose no text. Markup may nest, so pages are parsed in Arrow batches; cleaning, paragraphs and masking are expressions.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, *_SpeechText.read(markup or "", element)) for key, markup in zip(frame["key"], frame["html"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "outside", "blocks"])

    kind = pages.schema[id_col].dataType.simpleString()
    parsed = pages.select(F.col(id_col).alias("key"), F.col(html_col).alias("html")).mapInPandas(
        parse, f"key {kind}, outside string, blocks array<struct<kind:string,text:string>>"
    )
    spoken = F.filter(F.transform("blocks", lambda b: F.struct(b["kind"].alias("speaker_class"), X.clean_text(b["text"]).alias("text"))), lambda b: F.length(b["text"]) > 0)
    around = F.filter(X.paragraphs(X.clean_text(F.col("outside"))), lambda p: F.length(p) >= shortest)
    parsed = parsed.select("key", spoken.alias("spoken"), around.alias("around"))
    label = F.when(F.size("spoken") > 0, "agenda_or_header").otherwise("paragraph")
    blank = F.lit(None).cast("string")
    header = F.transform("around", lambda p: F.struct(label.alias("segment_type"), blank.alias("speaker_class"), p.alias("text")))
    speech = F.transform("spoken", lambda b: F.struct(F.lit("speech").alias("segment_type"), b["speaker_class"].alias("speaker_class"), b["text"].alias("text")))
    return parsed.select(F.col("key").alias(id_col), F.posexplode(F.concat(header, speech)).alias("ordinal", "s")).select(id_col, "ordinal", "s.*")


def sentences(texts: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """keys, sentence_order (from 1), text, char_start, char_end."""
    cut = texts.select(*keys, X.sentence_pieces(F.col(text_col)).alias("_pieces"))
    cut = cut.select(*keys, "_pieces", F.transform("_pieces", F.length).alias("_sizes"))
    spans = cut.select(*keys, F.posexplode(X.spans_of(F.col("_pieces"), F.col("_sizes"))).alias("i", "s"))
    return spans.select(*keys, (F.col("i") + 1).alias("sentence_order"), "s.*")


def mentions(texts: DataFrame, keys: Sequence[str], text_col: str, terms: DataFrame, base_col: Column | None = None) -> DataFrame:
    """keys, term, start_offset, end_offset and the columns of `terms` (term, ...): each occurrence, white space ignored.

    Occurrences of different terms may overlap; those of one term don't. A text is passed once for the whole vocabulary.
    """
    base = F.lit(0) if base_col is None else base_col
    c = X.text_or_empty(F.col(text_col))
    words, gaps = F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)), F.split(c, r"(?U)\S+", -1)
    rows = texts.select(*keys, base.alias("_base"), words.alias("_words"), gaps.alias("_gaps"))
    steps = F.transform("_words", lambda w, i: F.length(w) + F.length(F.get("_gaps", i)))
    rows = rows.withColumn("_steps", steps).withColumn("_before", X.sums_before(F.col("_steps"))).withColumn("_tight", F.array_join("_words", ""))

    def places(w: Column, i: Column) -> Column:
        start = F.get("_before", i) + F.length(F.get("_gaps", i))
        return F.sequence(start, start + F.length(w) - 1)

    rows = rows.withColumn("_at", F.flatten(F.transform("_words", places))).drop("_words", "_gaps", "_steps", "_before")
    vocabulary = terms.withColumn("_term", F.regexp_replace("term", r"(?U)\s+", ""))
    rows = with_hits(rows, "_tight", vocabulary, "_term", "_hits")

    def span(h: Column) -> Column:
        first, last = F.get("_at", h["start"]), F.get("_at", h["start"] + F.length(h["term"]) - 1)
        return F.struct(h["term"].alias("_term"), (F.col("_base") + first).alias("start_offset"), (F.col("_base") + last + 1).alias("end_offset"))

    found = rows.select(*keys, F.explode(F.transform("_hits", span)).alias("s")).select(*keys, "s.*")
    return small_join(found, vocabulary, ["_term"]).select(*keys, *terms.columns, "start_offset", "end_offset")


def issue_labels(
    rows: DataFrame, text_col: str, related: Column, rules: Sequence[Mapping], negative: Sequence[str], positive: Sequence[str], **negation: str | Sequence[str]
) -> DataFrame:
    """rows with a row per emitted issue: issue_code, category, polarity, confidence, reason, matched.

    A rule has code, category, high and context terms; single_context (one context term is enough), single_context_terms
    (which), standalone (high terms need no related subject unless one of `excluded` occurs), harm (an issue that needs
    a high or a harm term). Otherwise two different context terms are needed.
    """
    c = F.col(text_col)
    none = F.array().cast("array<string>")
    hits = lambda terms: X.active_hits(c, terms, tight=F.col("_tight"), **negation)
    # Columns of their own are computed once, however often the rules look at them.
    out = rows.withColumn("_tight", X.compact(c)).withColumns({"_against": hits(negative), "_favour": hits(positive)})
    opposed, favoured = F.size("_against") > 0, F.size("_favour") > 0
    out = out.withColumn("_polarity", F.when(opposed & favoured, "mixed").when(opposed, "opposition").when(favoured, "support").otherwise("neutral"))
    for i, rule in enumerate(rules):
        out = out.withColumns({f"_{k}{i}": hits(rule.get(k, ())) for k in ("high", "context", "harm")})
    found = []
    for i, rule in enumerate(rules):
        polarity, high, context, harm = F.col("_polarity"), F.col(f"_high{i}"), F.col(f"_context{i}"), F.col(f"_harm{i}")
        single = rule.get("single_context_terms", rule.get("context", ())) if rule.get("single_context") else ()
        has_high = F.size(high) > 0
        alone = F.lit(bool(rule.get("standalone"))) & has_high
        for word in rule.get("excluded", ()):
            alone = alone & ~X.text_or_empty(c).contains(word)
        one = F.size(F.array_intersect(context, F.array(*map(F.lit, single)) if single else none)) > 0
        if rule.get("harm"):
            reason = F.when(related & (has_high | (F.size(harm) > 0)), "subject_and_harm")
            matched = F.when(has_high, high).otherwise(harm)
        else:
            reason = F.when(related & has_high, "subject_and_high_term").when(related & one, "subject_and_term").when(related & (F.size(context) >= 2), "subject_and_terms")
            matched = F.when(has_high, high).otherwise(context)
        reason = F.when(alone, "standalone").otherwise(reason)
        sure = F.least(F.lit(0.98), F.lit(0.82) + F.lit(0.03) * F.least(F.size(F.array_distinct(matched)), F.lit(4)))
        issue = F.struct(
            F.lit(rule["code"]).alias("issue_code"), F.lit(rule["category"]).alias("category"), polarity.alias("polarity"),
            F.when(reason == "subject_and_term", F.lit(0.79)).otherwise(sure).alias("confidence"), reason.alias("reason"), matched.alias("matched"),
        )
        found.append(F.when(reason.isNotNull(), issue))
    return out.withColumn("_issue", F.explode(F.array_compact(F.array(*found)))).select(*rows.columns, "_issue.*")


def paragraph_labels(issues: DataFrame, keys: Sequence[str], order_col: str, text_col: str) -> DataFrame:
    """keys, issue_code, polarity, confidence, evidence (its sentence), evidence_sentences: the best sentence, the first of equals."""
    best = F.max_by(F.struct("polarity", "confidence", F.col(text_col).alias("evidence")), F.struct("confidence", -F.col(order_col)))
    every = F.transform(F.array_sort(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col])
    return issues.groupBy(*keys, "issue_code").agg(best.alias("b"), every.alias("evidence_sentences")).select(*keys, "issue_code", "b.*", "evidence_sentences")


def snippets(texts: DataFrame, keys: Sequence[str], text_col: str, terms: Sequence[str], generic: Sequence[str] = (), longest: int = 360) -> DataFrame:
    """keys, snippet: the best sentence (3 for each specific term, 1 for any), with a neighbour if that adds score and fits.

    Without a matching sentence, or where the result is too long, a plain window from 100 characters before the first hit.
    """
    parts = F.filter(F.transform(F.split(F.regexp_replace(X.text_or_empty(F.col(text_col)), r"\r\n?", "\n"), r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > 0)
    terms = list(dict.fromkeys(t for t in terms if t.strip()))
    specific = [t for t in terms if t not in set(generic)] or terms

    def score(s: Column) -> Column:
        return sum((s.contains(t).cast("int") * 3 for t in specific), F.lit(0)) + sum((s.contains(t).cast("int") for t in terms), F.lit(0))

    rows = texts.select(*keys, parts.alias("_parts")).withColumn("_scores", F.transform("_parts", score))
    rows = rows.withColumn("_whole", F.array_join("_parts", " ")).withColumn("_best", F.array_position("_scores", F.array_max("_scores")).cast("int"))

    def bounds(first: Column, last: Column) -> Column:
        joined = F.array_join(F.slice("_parts", first, last - first + 1), " ")
        total = F.aggregate(F.slice("_scores", first, last - first + 1), F.lit(0), lambda a, b: a + b)
        valid = (first >= 1) & (last <= F.size("_parts")) & ((first == last) | (F.length(joined) <= longest))
        return F.when(valid, F.struct(total.alias("total"), (-F.length(joined)).alias("short"), (-first).alias("early"), last.alias("last"), joined.alias("joined")))

    b = F.col("_best")
    picked = F.array_max(F.array_compact(F.array(bounds(b, b), F.when(b > 1, bounds(b - 1, b)), F.when(b < F.size("_parts"), bounds(b, b + 1)))))
    rows = rows.withColumn("_picked", F.when(F.coalesce(F.array_max("_scores"), F.lit(0)) > 0, picked))
    marked = F.concat(F.when(F.col("_picked.early") < -1, "…").otherwise(""), F.col("_picked.joined"), F.when(F.col("_picked.last") < F.size("_parts"), "…").otherwise(""))
    source = F.coalesce(marked, F.col("_whole"))

    def window(v: Column, of: Sequence[str]) -> Column:
        places = [F.when(F.locate(t, v) > 0, F.locate(t, v) - 1) for t in of]
        start = F.greatest(F.lit(0), F.coalesce(F.array_min(F.array(*places)), F.lit(0)) - 100) if places else F.lit(0)
        cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(v, start + 1, F.lit(longest)), F.when(start + longest < F.length(v), "...").otherwise(""))
        return F.when(F.length(v) <= longest, v).otherwise(cut)

    alone = F.size("_parts") <= 1
    return rows.select(*keys, F.when(alone | F.col("_picked").isNull(), window(F.col("_whole"), terms)).otherwise(window(source, specific)).alias("snippet"))


def expand_terms(requests: DataFrame, keys: Sequence[str], text_col: str, synonyms: DataFrame) -> DataFrame:
    """keys, terms, codes: the synonym table's (trigger, priority, term, code) rows whose trigger the text contains, in order, once each."""
    hit = with_terms(requests.select(*keys, text_col), text_col, synonyms, "trigger")
    ordered = F.array_sort(F.collect_list(F.struct("priority", "term", "code")))
    return hit.groupBy(*keys).agg(ordered.alias("o")).select(
        *keys, F.array_distinct(F.transform("o", lambda x: x["term"])).alias("terms"), F.array_distinct(F.transform("o", lambda x: x["code"])).alias("codes")
    )


def running_offsets(parts: DataFrame, keys: Sequence[str], order: Sequence[str], text_col: str, gap: int = 1, most: int = 1_000_000) -> DataFrame:
    """parts with char_start, char_end in the document that joins them with `gap` characters between.

    A document of more than `most` parts is cut over many tasks (ranges.Stretches); the others are windows.
    """
    rows, size = parts.withColumn("_doc", F.struct(*keys)), F.length(text_col)
    usual, large = by_key_size(rows, "_doc", most)
    upto = Window.partitionBy("_doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = usual.withColumn("_upto", F.sum(size + gap).over(upto))
    if large is not None:
        out = out.unionByName(Stretches(large, "_doc", order).with_sum(size + gap, "_upto").done())
    return out.withColumn("char_start", F.coalesce(F.col("_upto") - size - gap, F.lit(0))).withColumn("char_end", F.col("char_start") + size).drop("_doc", "_upto")


def flatten_elements(roots: DataFrame, keys: Sequence[str], kids_col: str) -> DataFrame:
    """All elements of a tree of nested arrays of structs (field `kids`), level by level as deep as the type goes: keys, path, text, page."""
    level = roots.select(*keys, F.posexplode(kids_col).alias("_i", "element")).select(*keys, F.format_string("%05d", "_i").alias("path"), "element")
    found = level.select(*keys, "path", F.col("element.text").alias("text"), F.col("element.page").alias("page"))
    while "kids" in level.schema["element"].dataType.fieldNames():
        level = level.select(*keys, "path", F.posexplode("element.kids").alias("_i", "element")).select(*keys, F.concat_ws(".", "path", F.format_string("%05d", "_i")).alias("path"), "element")
        found = found.unionByName(level.select(*keys, "path", F.col("element.text").alias("text"), F.col("element.page").alias("page")))
    return found


def tree_elements(files: DataFrame, keys: Sequence[str], json_col: str, children: Sequence[str] = ("kids", "list items"), content: str = "content", page: str = "page number", levels: int = 4) -> DataFrame:
    """keys, path, text, page: all elements with content of the trees in a JSON column, however deep, without a schema.

    The root's first kind of children begin the tree; each element has the others below it, kind by kind. path orders elements
    as they are read: an element, then what is below it. Blanks and line ends of a text are single blanks; elements without
    text are left out, their children aren't. A missing page is 1. Text that is no JSON, or has no tree, has no elements.
    The tree is walked in rounds of `levels` levels, each level a step of one job. A round's elements are written once, and with
    them the elements that lie deeper, from which the next round begins.
    """
    field = lambda name, kind: F.try_variant_get("element", f"$[{_quoted(name)}]", kind)
    name = lambda k, i: F.concat(F.lit(str(k)), F.lpad(i.cast("string"), 8, "0"))
    read, parts = F.col("page").isNotNull(), [f"_part{k}" for k in range(len(children))]

    def step(rows: DataFrame) -> DataFrame:
        """Elements not yet read (without a page) are read, and their children come after them, not yet read; the others stay."""
        found = rows.select("*", *(F.coalesce(field(kind, "array<variant>"), F.array().cast("array<variant>")).alias(c) for kind, c in zip(children, parts, strict=True)))
        sizes = [F.size(c).alias(f"_size{k}") for k, c in enumerate(parts)]
        found = found.select(*keys, "path", "text", "page", *sizes, F.posexplode(F.flatten(F.array(F.array("element"), *parts))).alias("_i", "element"))
        own, at, names = F.col("_i") == 0, F.col("_i") - 1, []
        for k in range(len(children)):
            names.append(F.when(at < F.col(f"_size{k}"), name(k, at)))
            at = at - F.col(f"_size{k}")
        return found.select(
            *keys, F.when(own, F.col("path")).otherwise(F.concat_ws(".", "path", F.coalesce(*names))).alias("path"),
            F.when(own, F.when(read, F.col("text")).otherwise(field(content, "string"))).alias("text"),
            F.when(own, F.coalesce("page", field(page, "int"), F.lit(1))).alias("page"), F.when(~own, F.col("element")).alias("element"),
        )

    root = files.select(*keys, F.try_parse_json(json_col).alias("element")).select(*keys, F.posexplode(field(children[0], "array<variant>")).alias("_i", "element"))
    level, elements = root.select(*keys, name(0, F.col("_i")).alias("path"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("page"), "element"), None
    while True:
        for _ in range(levels):
            level = step(level)
        said = F.trim(F.regexp_replace("text", r"[\s\x{A0}]+", " "))
        made = settled(level.select(*keys, "path", said.alias("text"), F.when(F.col("page") == 0, 1).otherwise(F.col("page")).alias("page"), "element"), "tree-elements")
        rows = made.filter(read & (F.col("text") != "")).select(*keys, "path", "text", "page")
        elements = rows if elements is None else elements.unionByName(rows)
        level = made.filter(~read)
        if level.isEmpty():
            return elements


def _quoted(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def tree_pages(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, page, text: the elements' texts of each page in reading order, one a line. A page's elements come together, a file's don't."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda e: e["text"])
    return elements.groupBy(*keys, "page").agg(F.array_join(lines, "\n").alias("text"))
