"""Personal data: fixed patterns, and information-theoretic sanitisation.

Patterns give the protected entities. Corpus co-occurrence then estimates how
strongly other terms reveal them: over all distinct contexts, the pointwise
mutual information of a term and an entity, measured against the entity's own
information content. A context is a line, or of a long line a stretch of some
200 characters. A term whose share of that content exceeds the disclosure
threshold tells the entity to a reader who has the corpus, so it is masked
where both stand in one context.

Everything is DataFrame expressions. Offsets, which Spark's regular
expressions do not report, are the running lengths of the pieces between the
matches and of the matches. Running sums go by blocks, and texts are cut by
chunks, so that the work grows with a text's length and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fence, materialize

KINDS = ("email", "ip", "card", "phone")

# Fixed values of the contract, in a form that does not start anew inside a run
# of characters from which no match can follow; \G lets one start where the last ended.
_NAME = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
_HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_DIGIT = "[0-9]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum is a multiple of ten; every second digit from the right, the last not counted, is doubled."""
    back = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("decimal(38,0)"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["value"])


_SPAN = "struct<start:int,kind:int,end:int,value:string>"
#: Elements of a block of a running sum, code points of a chunk of a text.
_BLOCK, _CHUNK = 256, 1024


def _running(values: str, step: str, first: str = "0") -> str:
    """SQL for what the step has made of all values before each: (acc, x) -> step, over an array<int> column.

    An array grows by being copied, so results are collected block by block.
    """
    part = f"slice({values}, b * {_BLOCK} + 1, {_BLOCK})"
    grow = f"struct({step.replace('acc', 'held.at')} AS at, array_append(held.made, held.at) AS made)"
    none = "cast(array() AS array<int>)"
    blocks = f"transform(sequence(0, (size({values}) - 1) div {_BLOCK}), b -> aggregate({part}, {first}, (acc, x) -> {step}))"
    starts = f"aggregate({blocks}, struct({first} AS at, {none} AS made), (held, x) -> {grow}, held -> held.made)"
    return f"IF(size({values}) = 0, {none}, flatten(transform({starts}, (start, b) -> aggregate({part}, struct(start AS at, {none} AS made), (held, x) -> {grow}, held -> held.made))))"


def located(docs: DataFrame, text: str, pattern: str, out: str, hint: Column | None = None) -> DataFrame:
    """Add the matches of a pattern in a text, leftmost and not overlapping: array<struct<start, end, value>>.

    Arrays are zipped, not looked up inside lambdas: the optimizer puts what
    makes a column that is used once into the place of its use, and there it
    would be made anew for each element.
    """
    none, m, p, n, s = F.array().cast("array<string>"), *(f"{out}_{c}" for c in "mpns")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    docs = docs.withColumn(m, matches if hint is None else F.when(hint, matches).otherwise(none))
    docs = docs.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    docs = docs.withColumn(n, F.expr(f"zip_with({m}, slice({p}, 1, size({m})), (x, y) -> length(y) + length(x))"))
    docs = docs.withColumn(s, F.expr(_running(n, "acc + x")))
    docs = docs.withColumn(out, F.expr(f"zip_with({m}, zip_with({s}, slice({p}, 1, size({m})), (a, y) -> a + length(y)), (x, a) -> struct(a AS start, a + length(x) AS end, x AS value))"))
    return fence(docs, [out]).drop(m, p, n, s)  # explode() brings a filter on the array's size


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add __text (null text as empty) and __base: array<struct<start, kind, end, value>>, sorted; kind indexes KINDS.

    Leftmost matches that do not overlap, kind by kind; those that fail the
    kind's test are dropped and not tried again. No shuffle.
    """
    out = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("__digits", F.col("__text").rlike(_DIGIT))
    for kind in KINDS:
        hint = F.instr("__text", _HINTS[kind]) > 0 if _HINTS[kind] else F.lit(True)
        out = located(out, "__text", PATTERNS[kind], f"__{kind}", hint & (F.col("__digits") | F.lit(kind == "email")))
    found = [F.expr(f"transform(__{kind}, x -> struct(x.start AS start, {k} AS kind, x.end AS end, x.value AS value))") for k, kind in enumerate(KINDS)]
    kept = [f if kind == "email" else F.filter(f, _keeps(kind)) for kind, f in zip(KINDS, found)]
    out = out.withColumn("__base", F.when(sum((F.size(f"__{k}") for k in KINDS), F.lit(0)) > 0, F.array_sort(F.concat(*kept))).otherwise(F.expr(f"cast(array() AS array<{_SPAN}>)")))
    return fence(out, ["__base"]).drop("__digits", *(f"__{k}" for k in KINDS))


#: Share of an entity's information content that a term may reveal.
MAX_DISCLOSURE = 0.9
_TERM = r"[\p{L}\p{N}_]{3,}"
#: A line, or 200 characters of it up to the next blank outside a number, which is looked for in 256 more.
_CONTEXT = r"[^\n]{1,200}(?:[^\n\s]|(?<=[0-9().-])\x20(?=[0-9().-])){0,256}"


def contexts_of(found: DataFrame) -> DataFrame:
    """(doc_id, own, at, line, entities, terms) of the contexts with an entity, from rows with base spans.

    An entity counts for a context that holds all of it.
    """
    stretches = located(found.select("doc_id", "own", "__text"), "__text", _CONTEXT, "__stretch").select("doc_id", "own", F.explode("__stretch").alias("c"))
    lines = with_base_spans(stretches.select("doc_id", "own", F.col("c.start").alias("at"), F.col("c.value").alias("line")), "line").where(F.size("__base") > 0)
    lines = located(lines, "line", _TERM, "terms")
    return lines.select("doc_id", "own", "at", "line", F.array_sort(F.array_distinct(F.transform("__base", lambda x: x["value"]))).alias("entities"), "terms")


def disclosing_terms(docs: DataFrame, max_disclosure: float = MAX_DISCLOSURE) -> DataFrame:
    """(doc_id, own, more) of documents (doc_id, text, own): spans (start, end, value) of what reveals a protected entity beside it too strongly.

    With counts of different contexts over the whole corpus (copies of one are
    one), term t and entity e, it is
    log(N n(t,e) / ((n(t) + 1) n(e))) >= max_disclosure * log(N / n(e)).
    The one context more stands for those outside the corpus that hold the term
    without the entity. So every entity is assessed, one that stands in a
    single context too, and how rare its terms must be follows from the corpus:
    below about a thousand contexts no single one proves anything. Parts of the
    entity itself are no terms. Counts are pre-aggregated before every shuffle.
    """
    occurs = materialize(contexts_of(with_base_spans(docs).where(F.size("__base") > 0)), "contexts")
    lines = occurs.groupBy("line").agg(F.first("entities").alias("entities"), F.first(F.expr("array_distinct(transform(terms, t -> t.value))")).alias("terms"))
    lines = materialize(lines, "lines")
    entities = lines.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    entities = materialize(entities, "entities")  # so that Spark can split an entity of very many lines in the join
    others = F.expr("filter(terms, t -> instr(entity, t) = 0)")
    pairs = lines.select("terms", F.explode("entities").alias("entity")).select("entity", F.explode(others).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    pairs = materialize(pairs, "pairs").join(entities, "entity")
    every = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_CONTEXT), F.lit(0))).alias("line")).where(F.col("line").rlike(f"[^{SPACE}]"))
    n_lines = every.select(F.xxhash64("line")).distinct().count()
    words = every.distinct().select(F.explode(F.expr(f"array_distinct(regexp_extract_all(line, r'{_TERM}', 0))")).alias("term"))
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))
    told = F.log(F.lit(float(n_lines)) * F.col("n_te") / ((F.col("n_t") + 1) * F.col("n_e"))) >= max_disclosure * F.log(F.lit(float(n_lines)) / F.col("n_e"))
    disclosed = materialize(pairs.join(n_t, "term").where(told & (F.col("n_e") < n_lines)).select("entity", "term"), "disclosed")
    beside = occurs.select("doc_id", "own", "at", "terms", F.explode("entities").alias("entity")).select("doc_id", "own", "at", "entity", F.explode("terms").alias("t")).withColumn("term", F.col("t.value"))
    hits = beside.join(disclosed, ["entity", "term"]).select("doc_id", "own", F.struct((F.col("at") + F.col("t.start")).cast("int").alias("start"), F.lit(len(KINDS)).alias("kind"), (F.col("at") + F.col("t.end")).cast("int").alias("end"), F.col("term").alias("value")).alias("span"))
    return materialize(hits.groupBy("doc_id", "own").agg(F.collect_set("span").alias("more")), "terms")


def _cut(a: str, b: str) -> str:
    """SQL for the code points from a to b of a text, from its chunks; they are counted from the chunk's start only."""
    i, j = f"{a} div {_CHUNK}", f"({b} - 1) div {_CHUNK}"
    one = f"substring(get(__chunks, cast({i} AS int)), cast({a} % {_CHUNK} + 1 AS int), {b} - {a})"
    ends = f"substring(get(__chunks, cast({i} AS int)), cast({a} % {_CHUNK} + 1 AS int)), array_join(slice(__chunks, cast({i} + 2 AS int), cast({j} - {i} - 1 AS int)), ''), substring(get(__chunks, cast({j} AS int)), 1, cast(({b} - 1) % {_CHUNK} + 1 AS int))"
    return f"CASE WHEN {b} <= {a} THEN '' WHEN {i} = {j} THEN {one} ELSE concat({ends}) END"


def sanitize(docs: DataFrame, max_disclosure: float = MAX_DISCLOSURE) -> DataFrame:
    """Documents (doc_id, text and any other columns) with spans and sanitized text.

    Adds spans: array<struct<start, kind, end, value>>, sorted (kind 0-3 as in
    KINDS, 4 a disclosing term), n_email, n_ip, n_card, n_phone, n_term and
    sanitized: the text with each span replaced by its kind's mark (of spans
    that overlap, the first). A null text stays null and has no spans; null
    ids, repeated rows and further columns pass through, columns of these names
    are replaced; an empty table gives an empty one. Only rows with an entity
    are joined with terms, as the others have none.
    """
    own = F.xxhash64("text")  # with the id it tells rows apart, those without an id too
    more = disclosing_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("own")), max_disclosure)
    more = more.select(F.col("doc_id").alias("__key"), F.col("own").alias("__key_own"), F.col("more").alias("__more"))
    every = with_base_spans(docs).withColumn("__own", own)
    none = F.expr(f"cast(array() AS array<{_SPAN}>)")
    without = every.where(F.size("__base") == 0).withColumns({"__key": F.lit(None).cast("long"), "__key_own": F.lit(None).cast("long"), "__more": none})
    out = every.where(F.size("__base") > 0).join(more, F.col("doc_id").cast("long").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__key_own")), "left").unionByName(without)
    # Of the terms only those stay that overlap no base span: neither one that starts before them nor one that starts inside.
    out = out.withColumn("__all", F.when(F.size("__more") > 0, F.array_sort(F.concat("__base", "__more"))).otherwise(F.col("__base")))
    out = out.withColumn("__ends", F.expr("IF(size(__more) > 0, transform(__all, x -> IF(x.kind < 4, x.end, 0)), cast(array() AS array<int>))"))
    out = out.withColumn("__starts", F.expr("IF(size(__more) > 0, reverse(transform(__all, x -> IF(x.kind < 4, -x.start, -2147483647))), cast(array() AS array<int>))"))
    out = out.withColumn("__far", F.expr(_running("__ends", "greatest(acc, x)"))).withColumn("__near", F.expr(f"reverse({_running('__starts', 'greatest(acc, x)', '-2147483647')})"))
    free = "filter(zip_with(__all, zip_with(__far, __near, (a, b) -> struct(a, b)), (x, y) -> IF(x.kind < 4 OR (y.a <= x.start AND -y.b >= x.end), x, NULL)), x -> x IS NOT NULL)"
    out = out.withColumn("spans", F.when(F.size("__more") > 0, F.expr(free)).otherwise(F.col("__base")))
    for k, kind in enumerate((*KINDS, "term")):
        out = out.withColumn(f"n_{kind}", F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) AS long)"))
    out = out.withColumn("__ends", F.expr("transform(spans, x -> x.end)")).withColumn("__far", F.expr(_running("__ends", "greatest(acc, x)")))
    out = out.withColumn("__chunks", F.when(F.size("spans") > 0, F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("__far", F.expr("concat(__far, IF(size(spans) > 0, array(array_max(__ends)), cast(array() AS array<int>)))")).withColumn("__length", F.length("__text"))
    marks = "array('<EMAIL>', '<IP>', '<CARD>', '<PHONE>', '<TERM>')"
    masked = f"zip_with(spans, slice(__far, 1, size(spans)), (x, at) -> IF(x.start >= at, concat({_cut('at', 'x.start')}, element_at({marks}, x.kind + 1)), ''))"
    tail = _cut("get(__far, size(spans))", "__length")
    out = out.withColumn("sanitized", F.when(F.size("spans") > 0, F.expr(f"concat(array_join({masked}, ''), {tail})")).otherwise(F.col("text")))
    out = fence(out, ["spans", "sanitized", *(f"n_{k}" for k in (*KINDS, "term"))])
    return out.drop("__text", "__base", "__own", "__key", "__key_own", "__more", "__all", "__ends", "__starts", "__far", "__near", "__chunks", "__length")


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
