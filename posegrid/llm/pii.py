"""Personal data by patterns and bootstrapped contextual extraction. DataFrame functions only.

Base spans come from four patterns with checks. They are the seeds: the words around them induce
lexical patterns. Other tokens with digits or @ are candidate instances. Over the graph of
patterns and instances, a pattern's confidence in a kind is the mean score of the distinct
instances it was met with, smoothed, once `min_seeds` of them are seeds; a candidate of fitting
shape scores by its patterns' confidences. Candidates that score at least `accept` are seeds of
the next round, so patterns that only they induce are found too, until a round accepts no more.
As seeds are only ever added, confidences and scores never fall: once the number of accepted values
stays, so does everything else, and the last round is the fixed point.

Places are prefix sums over the pieces of a text, taken in blocks; words around an instance are
looked up by index. So the work for a text is nearly in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posegrid.session import discard, materialise

KINDS = ("email", "ip", "card", "phone")
ACCEPT, MIN_SEEDS, SMOOTH = 0.8, 5, 1.0
#: Instances of a pattern that one task takes; a pattern with more is dealt to several.
HOT = 100_000
#: Possessive repeats and look-behinds change no match of the plain patterns; they keep the search linear and its stack flat.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x20\x09-\x0D]++"
_HINT = {"email": "contains({t}, '@')", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "contains({t}, '+')"}
_SHAPE = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}$",
    "card": r"^(?:[^0-9]*[0-9]){8,19}[^0-9]*$",
    "phone": r"^[(+]?[0-9](?:[().\-]*[0-9]){6,14}$",
}
_SPAN = "array<struct<start:int,end:int,value:string>>"
_BLOCK = 128


def _placed(text: str, pattern: str, pick: str, fields: str, kind: str) -> str:
    """SQL for an array of structs of a pattern's matches in a column, those that `pick` wants.
    pick and fields are SQL over m (all matches), i (place in m) and start (in code points). Pieces
    between matches and matches alternate, so starts are sums of their lengths: of whole blocks
    before, and of the few in the match's own block."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    total = "(s, x) -> s + x"
    return f"""coalesce(flatten(transform(array(named_struct('g', split({text}, '{p}', -1), 'm', regexp_extract_all({text}, '{p}', 0))), a ->
      IF(size(a.m) = 0, cast(array() as {kind}), flatten(transform(array(named_struct('n', zip_with(slice(a.g, 1, size(a.m)), a.m, (g, w) -> length(g) + length(w)))), b ->
        flatten(transform(array(transform(sequence(0, (size(b.n) - 1) div {_BLOCK}), k -> aggregate(slice(b.n, k * {_BLOCK} + 1, {_BLOCK}), 0, {total}))), c ->
          flatten(transform(array(transform(sequence(0, size(c) - 1), k -> aggregate(slice(c, 1, k), 0, {total}))), d ->
            transform(transform(filter(sequence(0, size(a.m) - 1), i -> {pick.format(m="a.m")}),
              i -> named_struct('i', i, 'start', d[i div {_BLOCK}] + aggregate(slice(b.n, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, {total}) + length(a.g[i]))),
              q -> {fields.format(m="a.m", i="q.i", start="q.start")})))))))))), cast(array() as {kind}))"""


def _found(text: str, pattern: str) -> str:
    """SQL for all matches of a pattern in a column: start, end and value."""
    fields = "named_struct('start', {start}, 'end', {start} + length({m}[{i}]), 'value', {m}[{i}])"
    return _placed(text, pattern, "true", fields, _SPAN)


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN (length(d) - i) % 2 = 0 THEN cast(substring(d, i, 1) as int) "
    "WHEN cast(substring(d, i, 1) as int) > 4 THEN 2 * cast(substring(d, i, 1) as int) - 9 ELSE 2 * cast(substring(d, i, 1) as int) END) % 10 = 0"
)


def _passes(kind: str) -> str:
    """SQL for whether the match x holds."""
    if kind == "email":
        return "true"
    if kind == "ip":  # parts of any length; a number over 255 has a significant fourth digit or is larger
        return "forall(split(x.value, '[.]'), q -> length(regexp_replace(q, '^0+', '')) <= 3 AND cast(concat('0', right(q, 3)) as int) <= 255)"
    d = _digits("x.value")
    if kind == "card":
        return f"length({d}) BETWEEN 12 AND 19 AND exists(array({d}), d -> {_LUHN})"
    return f"length({d}) BETWEEN 9 AND 15"


def base_spans(text: str = "text") -> Column:
    """Array of (kind, start, end, value) of the checked pattern matches in a text column, ordered
    by start, then kind as listed. Matches of a kind are leftmost and don't overlap; failing ones
    are dropped without retries. Null texts have none."""
    kinds = []
    for i, k in enumerate(KINDS):
        kept = f"transform(filter({_found(text, PATTERNS[k])}, x -> {_passes(k)}), x -> named_struct('start', x.start, 'rank', {i}, 'end', x.end, 'value', x.value))"
        kinds.append(f"CASE WHEN {_HINT[k].format(t=text)} THEN {kept} ELSE cast(array() as array<struct<start:int,rank:int,end:int,value:string>>) END")
    return F.expr(f"array_sort(concat({', '.join(kinds)}))")


_TOKEN = "struct<start:int,token:string,l2:string,l1:string,r1:string>"


def _tokens(text: str) -> str:
    """SQL for a text's tokens with a digit or @: start, token, two words before, one after."""
    at = lambda o: f"coalesce(get({{m}}, {{i}} {o}), '')"
    fields = f"named_struct('start', {{start}}, 'token', {{m}}[{{i}}], 'l2', {at('- 2')}, 'l1', {at('- 1')}, 'r1', {at('+ 1')})"
    return _placed(text, WORD, "{m}[i] rlike '[0-9@]'", fields, f"array<{_TOKEN}>")


def _candidates(rows: DataFrame) -> DataFrame:
    """id, h, start, end, value, seed (rank of kind or null) and patterns of every base span and of
    every other token with a digit or @, without marks at its ends.

    A base span starts and ends within such tokens, which know the words beside them: in each
    document's order of places, these are the last tokens before the span's two ends."""
    some = rows.where(F.expr("text rlike '[0-9@]'"))
    tokens = some.select("id", "h", F.explode(F.expr(_tokens("text"))).alias("t")).distinct()
    spans = some.select("id", "h", F.explode("spans").alias("b")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    b = "struct<start:int,rank:int,end:int,value:string>"
    places = tokens.select("id", "h", F.col("t.start").alias("at"), F.lit(0).alias("what"), "t", none(b).alias("b"))
    for what, at in ((1, "b.start"), (2, "b.end - 1")):
        places = places.unionByName(spans.select("id", "h", F.expr(at).alias("at"), F.lit(what).alias("what"), none(_TOKEN).alias("t"), "b"))
    order = Window.partitionBy("id", "h").orderBy("at", "what")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("id", "h").orderBy(F.desc("at"), F.desc("what")).rowsBetween(Window.unboundedPreceding, -1)
    near = places.select("*", F.last("t", True).over(before).alias("own"), F.max("b.end").over(before).alias("covered"), F.min("b.start").over(after).alias("next"))
    free = near.where("what = 0 AND NOT coalesce(covered > t.start, false) AND NOT coalesce(next < t.start + length(t.token), false)")
    trim = "regexp_replace(t.token, '^[^0-9A-Za-z@+]+', '')"
    free = free.select("id", "h", F.expr(f"t.start + length(t.token) - length({trim})").alias("start"), F.expr(f"regexp_replace({trim}, '[^0-9A-Za-z@]+$', '')").alias("value"), F.col("t.l2").alias("far"), F.col("t.l1").alias("near"), F.col("t.r1").alias("right")).where("length(value) > 0")
    free = free.select("id", "h", "start", F.expr("start + length(value)").alias("end"), "value", none("int").alias("seed"), "far", "near", "right")
    ends = near.where("what > 0").groupBy("id", "h", "b").agg(F.max(F.when(F.col("what") == 1, F.col("own"))).alias("l"), F.max(F.when(F.col("what") == 2, F.col("own"))).alias("r"))
    cut = ends.select("*", F.expr("substring(l.token, 1, b.start - l.start)").alias("head"), F.expr("substring(r.token, b.end - r.start + 1)").alias("tail"))
    known = cut.select("id", "h", "b.start", "b.end", "b.value", F.col("b.rank").alias("seed"), F.expr("IF(head = '', l.l2, l.l1)").alias("far"), F.expr("IF(head = '', l.l1, head)").alias("near"), F.expr("IF(tail = '', r.r1, tail)").alias("right"))
    # digits in a pattern are only digits: a number beside another must not make every context its own
    patterns = "transform(array(concat('L ', far, ' ', near), concat('B ', near, ' _ ', right)), p -> regexp_replace(lower(p), '[0-9]+', '0')) AS patterns"
    return known.unionByName(free).selectExpr("id", "h", "start", "end", "value", "seed", patterns)


def _graph(items: DataFrame, hot: int) -> DataFrame:
    """value, pattern, kind (rank of a seed's kind, or null) and salt: the instances of a pattern
    that holds over `hot` of them are dealt to as many salts as they fill."""
    kinds = items.groupBy("value").agg(F.max("seed").alias("kind"))
    edges = materialise(items.select("value", F.explode("patterns").alias("pattern")).distinct().join(kinds, "value"), "pii-edges")
    large = edges.groupBy("pattern").count().where(F.col("count") > hot).select("pattern", F.ceil(F.col("count") / hot).alias("salts"))
    salt = F.expr("cast(pmod(xxhash64(value), coalesce(salts, 1L)) as int)")
    graph = materialise(edges.join(large, "pattern", "left").select("value", "pattern", "kind", salt.alias("salt")), "pii-graph")
    discard(edges)
    return graph


def _accepted(graph: DataFrame, accept: float, min_seeds: int, hot: int) -> DataFrame:
    """A table of value and rank of kind of the candidates that are accepted at the fixed point."""
    n = range(len(KINDS))
    accepted, before = None, -1
    while True:
        marks = graph if accepted is None else graph.join(accepted, "value", "left")
        own = lambda k: (F.col("kind") == k) if accepted is None else F.coalesce(F.col("kind") == k, F.array_contains("ranks", k))  # noqa: E731, B023
        trust = marks.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(own(k), 1)).alias(f"q{k}") for k in n])
        trust = trust.where(F.greatest(*[F.col(f"q{k}") for k in n]) >= min_seeds)
        salts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("n") / hot) - 1).cast("int")))
        trust = trust.select("pattern", F.explode(salts).alias("salt"), *[F.when(F.col(f"q{k}") >= min_seeds, F.col(f"q{k}") / (F.col("n") + SMOOTH)).otherwise(0.0).alias(f"c{k}") for k in n])
        told = graph.where("kind IS NULL").join(trust, ["pattern", "salt"])
        told = told.groupBy("value").agg(*[F.sum(F.log(1.0 - F.least(F.col(f"c{k}"), F.lit(0.999999)))).alias(f"l{k}") for k in n])
        scores = [F.when(F.col("value").rlike(_SHAPE[kind]), F.round(1.0 - F.exp(f"l{k}"), 9)).otherwise(0.0).alias(f"s{k}") for k, kind in enumerate(KINDS)]
        told = told.select("value", *scores)
        best = F.greatest(*[F.col(f"s{k}") for k in n])
        ranks = F.array_compact(F.array(*[F.when(F.col(f"s{k}") >= accept, k) for k in n]))
        told = told.where(best >= accept).select("value", (F.array_position(F.array(*[f"s{k}" for k in n]), best) - 1).cast("int").alias("rank"), ranks.alias("ranks"))
        now = materialise(told, "pii-accepted")
        if accepted is not None:
            discard(accepted)
        accepted, count = now, now.agg(F.count("*"), F.sum(F.size("ranks"))).first()
        if count == before or not count[0]:
            return accepted
        before = count


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, min_seeds: int = MIN_SEEDS, keep: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """id, base and spans (arrays of start, rank, end in code points; rank is the kind's place in
    KINDS), and the columns in keep, one row per input row. spans has base and what the method added.

    Null and empty texts have no spans. Rows with one id and one text have the same result; null
    ids are an id of their own. Empty tables give empty results. Columns not named are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("spans", base_spans("text"))
    items = materialise(_candidates(rows.select("id", "h", "text", "spans")), "pii-items")
    graph = _graph(items, hot)
    accepted = _accepted(graph, accept, min_seeds, hot)
    new = items.where("seed IS NULL").join(accepted.select("value", "rank"), "value")
    new = materialise(new.groupBy("id", "h").agg(F.collect_set(F.struct("start", "rank", "end")).alias("more")), "pii-new")
    for table in (items, graph, accepted):
        discard(table)
    base = rows.select("id", "h", F.expr("transform(spans, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end))").alias("base"), *[f"kept_{c}" for c in keep])
    out = base.join(new, base["id"].eqNullSafe(new["id"]) & (base["h"] == new["h"]), "left").drop(new["id"]).drop(new["h"])
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select(F.col("id").alias(id_col), "base", every.alias("spans"), *[F.col(f"kept_{c}").alias(c) for c in keep])


def span_text(spans: str) -> str:
    """SQL for kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.rank + 1), ':', x.start, ':', x.end)), ',')"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, same columns, with every span of the text replaced by its kind in square
    brackets (of overlapping spans the first) and size_col set to the new length. Null texts stay null."""
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = find_pii(packed, "id", "text", keep=("row",))
    kinds = ", ".join(f"'[{k}]'" for k in KINDS)
    text = f"row.`{text_col}`"
    clean = f"""CASE WHEN size(spans) = 0 THEN {text} ELSE aggregate(spans, named_struct('at', 0, 'out', '')
      , (s, x) -> IF(x.start < s.at, s, named_struct('at', x.end, 'out', concat(s.out, substring({text}, s.at + 1, x.start - s.at), element_at(array({kinds}), x.rank + 1))))
      , s -> concat(s.out, substring({text}, s.at + 1))) END"""
    out = found.select("row", F.expr(clean).alias("clean"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("clean").alias(c))
        elif c == size_col:
            cols.append(F.coalesce(F.length("clean").cast(docs.schema[c].dataType), F.col(f"row.`{c}`")).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)
