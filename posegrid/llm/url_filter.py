"""URL filters by a path-template tree. Built of DataFrame functions only.

Under each host, paths form a tree of segments. Variable segments (with digits, or long) become
wildcards. Then, level by level from the top, the children of each node are compared: a child's
evidence is its URLs that rules judge, and one vote of each domain that has judged URLs under the
same path; a child whose share of blocked ones doesn't differ from that of its siblings by more
than two standard errors becomes a wildcard too, as does one without evidence. The children of
merged siblings are pooled before the next level is compared, so branches merge at inner nodes as
well. A path that is alone under its node has no siblings further down, so it leaves the comparison
there: levels go on to the deepest branch, however deep that is. What is left are templates. A template's share of blocked
URLs on its host is smoothed towards that of the URL's own path over all domains, where each domain
has one vote, so one large site does not decide for others. Templates with a smoothed share of at
least `reject` are blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.session import discard, materialise

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SMOOTH, REJECT = 2.0, 0.7
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A to Z lower-cased) and path; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    name = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def segments_of(path: Column) -> Column:
    """The path's segments, lower-cased, with variable ones as *."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > 24), F.lit("*")).otherwise(F.lower(s)))


def _grown(leaves: DataFrame) -> DataFrame:
    """leaves (host, domain, segs, n, bad, known) with template, the tree merged at every level."""
    names = [*leaves.columns, "template"]
    done, cur, level = [], leaves.withColumn("template", F.lit("")), 0
    while True:
        # a leaf alone in its node, or at its end, keeps what is left of its path
        beside = cur.groupBy("host", "template").agg((F.count("*") > 1).alias("many"))
        split = cur.join(beside, ["host", "template"]).withColumn("open", F.col("many") & (F.size("segs") > level))
        split = materialise(split.select(*names, "open"), "url-split")
        if level:
            discard(cur)
        rest = F.expr(f"transform(slice(segs, {level + 1}, size(segs)), s -> concat('/', s))")
        done.append(split.where("NOT open").withColumn("template", F.concat("template", F.array_join(rest, ""))).select(names))
        here = split.where("open").drop("open")
        if here.isEmpty():
            break
        level += 1
        here = here.withColumn("seg", F.get("segs", F.lit(level - 1))).withColumn("path", F.array_join(F.slice("segs", 1, level), "/"))
        deep = leaves.where((F.size("segs") >= level) & (F.col("known") > 0)).withColumn("path", F.array_join(F.slice("segs", 1, level), "/"))
        votes = deep.groupBy("domain", "path").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
        votes = votes.groupBy("path").agg(F.round(F.sum(F.col("bad") / F.col("known")), 9).alias("votes"), F.count("*").alias("voters"))
        own = here.groupBy("host", "template", "seg", "path").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")).join(votes, "path", "left")
        child = own.groupBy("host", "template", "seg").agg(F.round(F.sum("bad") + F.sum(F.coalesce("votes", F.lit(0.0))), 6).alias("bad"), (F.sum("known") + F.sum(F.coalesce("voters", F.lit(0)))).alias("known"))
        parent = child.groupBy("host", "template").agg(F.count("*").alias("children"), F.round(F.sum("bad"), 6).alias("all_bad"), F.sum("known").alias("all_known"))
        both = child.join(parent, ["host", "template"])
        share = (F.col("all_bad") + 1.0) / (F.col("all_known") + 2.0)
        mine, others = F.nullif(F.col("known"), F.lit(0)), F.nullif(F.col("all_known") - F.col("known"), F.lit(0))
        apart = F.col("bad") / mine - (F.col("all_bad") - F.col("bad")) / others
        alike = F.coalesce(apart * apart <= 4.0 * share * (1.0 - share) * (1.0 / mine + 1.0 / others), F.lit(True))
        named = both.select("host", "template", "seg", F.when((F.col("children") > 1) & alike, F.lit("*")).otherwise(F.col("seg")).alias("to"))
        below = here.join(named, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), "to"))
        cur = materialise(below.select(names), "url-tree")
    tree = done[0]
    for more in done[1:]:
        tree = tree.unionByName(more)
    return tree


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """id, host, path, rule, template, blocked_share and verdict for every row.

    The verdict is the rule's, else block where the template's smoothed share of blocked URLs is
    at least `reject`, else allow. Null URLs and URLs without :// have empty host and path and the template /. Repeated
    rows count as often as they come. Empty tables give empty results; columns other than the two
    named are not read.
    """
    host, path = split_url(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("said", said).withColumn("segs", segments_of(F.col("path")))
    leaves = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count(F.when(F.col("said") == "block", 1)).alias("bad"), F.count("said").alias("known"))
    leaves = materialise(leaves.withColumn("domain", F.regexp_extract("host", "([^.]*\\.?[^.]*)$", 1)), "url-leaves")
    tree = _grown(leaves)
    own = tree.groupBy("host", "template").agg(F.sum("bad").alias("used_bad"), F.sum("known").alias("used"))
    votes = leaves.where("known > 0").groupBy("domain", "segs").agg((F.sum("bad") / F.sum("known")).alias("vote"))
    votes = votes.groupBy("segs").agg(F.round(F.sum("vote"), 9).alias("votes"), F.count("*").alias("voters"))
    prior = (F.coalesce("votes", F.lit(0.0)) + smooth * 0.5) / (F.coalesce("voters", F.lit(0)) + smooth)
    judged = tree.select("host", "segs", "template").join(own, ["host", "template"]).join(votes, "segs", "left")
    judged = judged.select("host", "segs", "template", F.round((F.col("used_bad") + smooth * prior) / (F.col("used") + smooth), 9).alias("blocked_share"))
    out = rows.join(judged, ["host", "segs"])
    verdict = F.coalesce("said", F.when(F.col("blocked_share") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    template = F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", template.alias("template"), "blocked_share", verdict.alias("verdict"))


#: The same in DuckDB's SQL, for the default rules and numbers: one turn of the recursion a level.
#: A window row marked rp, rd or rc is the first of its path, domain and path, or child: sums take these.
SQL = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS raw FROM parts),
rows_ AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said,
         list_transform(raw, lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > 24 THEN '*' ELSE lower(s) END) AS segs FROM ruled),
leaves AS (
  SELECT host, regexp_extract(host, '([^.]*\\.?[^.]*)$', 1) AS domain, segs, count(*) AS n, count(CASE WHEN said = 'block' THEN 1 END) AS bad, count(said) AS known FROM rows_ GROUP BY ALL),
t AS (
  SELECT 0 AS k, host, domain, segs, n, bad, known, '' AS template FROM leaves
  UNION ALL
  SELECT k + 1, host, domain, segs, n, bad, known, template || '/' || CASE WHEN children > 1 AND coalesce(
      pow(c_bad / nullif(c_known, 0) - (all_bad - c_bad) / nullif(all_known - c_known, 0), 2) <= 4.0 * ((all_bad + 1.0) / (all_known + 2.0)) * (1.0 - (all_bad + 1.0) / (all_known + 2.0)) * (1.0 / nullif(c_known, 0) + 1.0 / nullif(all_known - c_known, 0)), true) THEN '*' ELSE seg END
  FROM (
    SELECT *, sum(CASE WHEN rc = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY host, template) AS children, round(sum(CASE WHEN rc = 1 THEN c_bad ELSE 0.0 END) OVER (PARTITION BY host, template), 6) AS all_bad,
           sum(CASE WHEN rc = 1 THEN c_known ELSE 0.0 END) OVER (PARTITION BY host, template) AS all_known
    FROM (
      SELECT *, row_number() OVER (PARTITION BY host, template, seg) AS rc,
             round((sum(bad) OVER (PARTITION BY host, template, seg))::DOUBLE + sum(CASE WHEN rp = 1 THEN coalesce(votes, 0.0) ELSE 0.0 END) OVER (PARTITION BY host, template, seg), 6) AS c_bad,
             (sum(known) OVER (PARTITION BY host, template, seg) + sum(CASE WHEN rp = 1 THEN voters ELSE 0 END) OVER (PARTITION BY host, template, seg))::DOUBLE AS c_known
      FROM (
        SELECT *, row_number() OVER (PARTITION BY host, template, seg, path) AS rp, round(sum(CASE WHEN rd = 1 AND d_known > 0 THEN d_bad / d_known END) OVER (PARTITION BY path), 9) AS votes,
               sum(CASE WHEN rd = 1 AND d_known > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path) AS voters
        FROM (
          SELECT *, row_number() OVER (PARTITION BY domain, path) AS rd, (sum(bad) OVER (PARTITION BY domain, path))::DOUBLE AS d_bad, (sum(known) OVER (PARTITION BY domain, path))::DOUBLE AS d_known
          FROM (SELECT *, segs[k + 1] AS seg, array_to_string(segs[1:k + 1], '/') AS path FROM t WHERE len(segs) > k) w1) w2) w3) w4) w5),
tree AS (SELECT * FROM t WHERE k = len(segs)),
own AS (SELECT host, template, sum(bad) AS used_bad, sum(known) AS used FROM tree GROUP BY ALL),
votes AS (
  SELECT segs, round(sum(vote), 9) AS votes, count(*) AS voters FROM (
    SELECT domain, segs, sum(bad)::DOUBLE / sum(known) AS vote FROM leaves WHERE known > 0 GROUP BY ALL) GROUP BY ALL),
judged AS (
  SELECT t.host, t.segs, round((used_bad + {SMOOTH} * (coalesce(votes, 0.0) + {SMOOTH} * 0.5) / (coalesce(voters, 0) + {SMOOTH})) / (used + {SMOOTH}), 9) AS share
  FROM tree t JOIN own o ON t.host = o.host AND t.template = o.template LEFT JOIN votes v ON t.segs = v.segs)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN j.share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ r JOIN judged j ON r.host = j.host AND r.segs = j.segs
"""
