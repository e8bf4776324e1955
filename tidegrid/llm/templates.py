"""URL verdicts: rules first, then a tree of path templates per host.

Rules name a host and the start of a path; of those that fit, the one of the
longest host and then the longest path wins. What no rule fits is judged by the
templates of its host, learnt from the pages that a rule did judge:

* Segments. A path is cut at `/` into segments, the last level holding all that
  is left. Going down, a segment stays as it is at a node where it has at least
  a sixteenth of the pages and three at least; else it becomes a wildcard with
  its extension (`*.html`) if those have as many together, else `*`.
* Merging. Going up again, the branches of a node are compared by what lies
  below them: the templates below, each parted into pages allowed by a rule,
  blocked by one, or neither. Branches stand in the order of their blocked and
  allowed shares; neighbours that a chi-square test of homogeneity does not tell
  apart become one branch, named after all its members.
* Purity. A template is rejected if (blocked + 1) / (labelled + 2) is at least
  4/5, so that three pages, all blocked, are the least evidence. A template
  without labels, or with mixed ones, is allowed: that a rule blocks one branch
  of a host says nothing about branches that differ from it.

All of it is column expressions over counts by host and path: pages are added
up before anything else moves, a node's wide sets of segments are cut to the
33 that can matter before they meet, and joins with a host or path that very
many rows share are salted. Nothing comes to the driver.

Results in special cases: a null url, or one without `://`, has an empty host
and path, no rule, and is allowed unless such pages had labels (rules of an
empty host do not exist). Rows that repeat are judged alike. Paths of any length
or depth are one string and at most four segments. Segments that look like a
wildcard or a merged name fall together with it. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

# Verdict, host, path; at most some hundreds, they are part of the plan.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEPTH = 4  # levels of a tree; the last holds the rest of the path
LITERAL_PARTS = 16  # a segment stays with one of so many parts of its node's pages,
LITERAL_PAGES = 3  # and at least so many pages
REJECT = (4, 5)  # the smoothed share of blocked pages from which a template is rejected
SALTS = 16
Z = 1.6449  # of the normal distribution, at 95 %
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
EXTENSION = r"(\.[A-Za-z0-9]{1,5})$"
LEVELS = [f"t{k}" for k in range(DEPTH)]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"))
    return rows.select("page_id", F.translate(F.regexp_extract("url", URL, 1), UPPER, LOWER).alias("host"), F.regexp_extract("url", URL, 2).alias("path"))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name and the verdict of the rule that wins, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of_host, of_path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):  # later ones win
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        name, verdict = F.when(fits, F.lit(of_host + of_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def salted(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def generalised(paths: DataFrame) -> DataFrame:
    """host, path, n, blocked, allowed and the tokens t0, t1, ... of the path; null past its end.

    paths: host, path, n, blocked, allowed.
    """
    # The empty string before the first `/` is no segment; a path without a first `/` begins with one.
    pieces = F.split(F.regexp_replace("path", "^/", ""), "/", DEPTH)
    rows = paths.withColumn("pieces", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(pieces))
    for k, level in enumerate(LEVELS):
        above = ["host", *LEVELS[:k]]
        piece = F.get("pieces", F.lit(k))
        rows = rows.withColumn("piece", piece).withColumn("wild", F.concat(F.lit("*"), F.regexp_extract(piece, EXTENSION, 1)))
        # Kind 0 is the node's total, 1 its segments, 2 its wildcards with extension.
        tokens = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), token.alias("token")) for kind, token in enumerate([F.lit(""), F.col("piece"), F.col("wild")])])).alias("t")
        counts = rows.where(F.col("piece").isNotNull()).select(*above, tokens, "n").groupBy(*above, "t.kind", "t.token").agg(F.sum("n").alias("n"))
        # Of each kind, at most LITERAL_PARTS have their part; the total is the first of all.
        first = Window.partitionBy(*above).orderBy(F.desc("n"), "kind", "token")
        counts = counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * LITERAL_PARTS + 1)
        nodes = counts.groupBy(*above).agg(F.max("n").alias("total"), F.collect_list(F.struct("kind", "token", "n")).alias("tokens"))
        keep = lambda kind: F.transform(F.filter("tokens", lambda t: (t["kind"] == kind) & (t["n"] * LITERAL_PARTS >= F.col("total")) & (t["n"] >= LITERAL_PAGES)), lambda t: t["token"])
        nodes = salted(nodes.select(*[F.col(c).alias(f"_{c}") for c in above], keep(1).alias("literals"), keep(2).alias("wilds")))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in above])
        rows = rows.withColumn("own_salt", salt_of("host", "path")).join(nodes, same & (F.col("own_salt") == F.col("salt")), "left")
        token = F.when(F.array_contains("literals", F.col("piece")), F.col("piece")).when(F.array_contains("wilds", F.col("wild")), F.col("wild")).otherwise(F.lit("*"))
        rows = stored(rows.select(*[c for c in ["host", "path", "pieces", "n", "blocked", "allowed", *LEVELS[:k]]], F.when(F.col("piece").isNotNull(), token).alias(level)))
    return rows.drop("pieces")


def critical(df: Column) -> Column:
    """The 95 % point of the chi-square distribution (Wilson and Hilferty's approximation)."""
    v = F.lit(2.0) / (F.lit(9.0) * df)
    return df * F.pow(F.lit(1.0) - v + F.lit(Z) * F.sqrt(v), F.lit(3.0))


def merged(leaves: DataFrame) -> DataFrame:
    """The names m0, m1, ... of the merged branches that each template (host, t0, t1, ...) lies in.

    leaves: host, t0, ..., n, blocked, allowed, a row for each template.
    """
    rows = leaves.select("host", *LEVELS, *[F.col(c).alias(f"m{k}") for k, c in enumerate(LEVELS)], "n", "blocked", "allowed")
    for k in reversed(range(DEPTH)):
        # What lies below a branch: the merged names of lower levels, with the number of levels where the path ends.
        parent, branch = ["host", *LEVELS[:k]], f"m{k}"
        below = F.concat_ws("/", *[f"m{j}" for j in range(k + 1, DEPTH)])
        depth = reduce(Column.__add__, [F.col(f"m{j}").isNotNull().cast("int") for j in range(k, DEPTH)])
        by_state = [F.col("n") - F.col("blocked") - F.col("allowed"), F.col("allowed"), F.col("blocked")]
        states = F.explode(F.array(*[F.struct(F.lit(state).alias("state"), c.alias("c")) for state, c in enumerate(by_state)])).alias("s")
        own = rows.where(F.col(branch).isNotNull())
        cells = stored(own.select(*parent, branch, depth.alias("depth"), below.alias("below"), states).where("s.c > 0").groupBy(*parent, branch, "depth", "below", "s.state").agg(F.sum("s.c").alias("c")))
        sizes = cells.groupBy(*parent, branch).agg(F.sum("c").alias("n"), *[F.sum(F.when(F.col("state") == s, F.col("c")).otherwise(0)).alias(a) for s, a in ((1, "a"), (2, "b"))])
        # A node has at most 2 * LITERAL_PARTS + 1 branches.
        order = Window.partitionBy(*parent).orderBy(F.col("b").cast("double") / F.col("n"), F.col("a").cast("double") / F.col("n"), branch)
        sizes = stored(sizes.withColumn("place", F.row_number().over(order)))
        placed = cells.join(sizes.select(*parent, branch, "place", F.col("n").alias("size")), _same(cells, sizes, [*parent, branch])).select(*[cells[c] for c in parent], "depth", "below", "state", "c", "place", "size")
        # Each cell is compared with that of the next branch: sum of (c1 n2 - c2 n1)^2 / (n1 n2 (c1 + c2)).
        sides = F.explode(F.array(*[F.struct((F.col("place") - s).alias("pair"), F.lit(s + 1).alias("side")) for s in (0, 1)])).alias("p")
        sides = placed.select(*parent, "depth", "below", "state", sides, "c")
        side = lambda s: F.sum(F.when(F.col("p.side") == s, F.col("c")).otherwise(0))
        both = sides.groupBy(*parent, "depth", "below", "state", F.col("p.pair").alias("pair")).agg(side(1).alias("c1"), side(2).alias("c2"))
        nexts = sizes.select(*parent, (F.col("place") - 1).alias("pair"), F.col("n").alias("n2"))
        n1 = sizes.select(*parent, F.col("place").alias("pair"), F.col("n").alias("n1"))
        pairs = n1.join(nexts, _same(n1, nexts, [*parent, "pair"])).select(*[n1[c] for c in [*parent, "pair"]], "n1", "n2")
        part = both.join(pairs, _same(both, pairs, [*parent, "pair"])).select(*[both[c] for c in [*parent, "pair"]], "c1", "c2", F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"))
        apart = F.col("c1") * F.col("n2") - F.col("c2") * F.col("n1")
        test = part.groupBy(*parent, "pair").agg(F.sum(apart * apart / (F.col("n1") * F.col("n2") * (F.col("c1") + F.col("c2")))).alias("chi"), (F.count("*") - 1).cast("double").alias("df"))
        alike = test.where((F.col("df") == 0) | (F.col("chi") <= critical(F.col("df")))).select(*parent, (F.col("pair") + 1).alias("place"))
        # Runs of branches that are each like the one before.
        joined = sizes.join(alike.withColumn("alike", F.lit(0)), _same(sizes, alike, [*parent, "place"]), "left").select(*[sizes[c] for c in [*parent, branch, "place"]], F.coalesce("alike", F.lit(1)).alias("new"))
        joined = joined.withColumn("run", F.sum("new").over(Window.partitionBy(*parent).orderBy("place")))
        names = joined.withColumn("name", F.array_join(F.array_sort(F.collect_list(branch).over(Window.partitionBy(*parent, "run"))), "|"))
        names = stored(names.select(*parent, branch, "name"))
        # A node may have very many templates below it, but only few names.
        wide = salted(names)
        rows = rows.withColumn("own_salt", salt_of("host", *LEVELS))
        found = rows.join(wide, _same(rows, wide, [*parent, branch]) & (rows["own_salt"] == wide["salt"]), "left")
        rows = stored(found.select(*[rows[c] for c in ["host", *LEVELS]], *[F.col("name").alias(branch) if j == k else rows[f"m{j}"] for j in range(DEPTH)], rows["n"], rows["blocked"], rows["allowed"]))
    return rows


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def template_tree(labelled: DataFrame) -> DataFrame:
    """Each path and its template: host, path, n, t0, ..., m0, ..., template, blocked, allowed (of the template), rejected.

    labelled: host, path, label (`allow`, `block` or null), a row for each page.
    """
    count = lambda kind: F.sum(F.when(F.col("label") == kind, 1).otherwise(0)).alias(kind)
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), count("block"), count("allow"))
    paths = generalised(stored(paths.select("host", "path", "n", F.col("block").alias("blocked"), F.col("allow").alias("allowed"))))
    sums = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    leaves = merged(stored(paths.groupBy("host", *LEVELS).agg(*sums)))
    names = [f"m{k}" for k in range(DEPTH)]
    # Parts beneath merged branches meet again here: a template's labels are those of all that bear its names.
    text = F.concat(F.lit("/"), F.concat_ws("/", *names))
    rejected = (F.col("blocked") + 1) * REJECT[1] >= (F.col("blocked") + F.col("allowed") + 2) * REJECT[0]
    judged = leaves.groupBy("host", *names).agg(*sums[1:]).select("host", *names, text.alias("template"), "blocked", "allowed", rejected.alias("rejected"))
    of = leaves.select("host", *LEVELS, *names)
    of = of.join(judged, _same(of, judged, ["host", *names])).select(of["host"], *[of[c] for c in LEVELS], "template", judged["blocked"], judged["allowed"], "rejected")
    wide = salted(of)
    paths = paths.withColumn("own_salt", salt_of("host", "path"))
    found = paths.join(wide, _same(paths, wide, ["host", *LEVELS]) & (paths["own_salt"] == wide["salt"]))
    return found.select(paths["host"], paths["path"], "n", "template", wide["blocked"], wide["allowed"], "rejected")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, template, verdict; the template is given where it has been rejected."""
    rows = parsed(pages)
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"))
    tree = stored(template_tree(rows.select("host", "path", F.col("by_rule").alias("label"))))
    bad = salted(tree.where("rejected").select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "template"))
    rows = rows.withColumn("own_salt", F.when(F.col("by_rule").isNull(), salt_of("page_id")))  # null joins nothing
    rows = rows.join(bad, (rows["host"] == bad["of_host"]) & (rows["path"] == bad["of_path"]) & (rows["own_salt"] == bad["salt"]), "left")
    by_tree = F.when(F.col("template").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", "template", F.coalesce("by_rule", by_tree).alias("verdict"))


def op12_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rules_sql(rules: Sequence[tuple[str, str, str]], what: int) -> str:
    cases = "".join(
        f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v if what else h + p}'"
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1]), -len(r[2])))
    )
    return f"case{cases} end"


def _level_sql(k: int) -> str:
    above = ", ".join(["host", *LEVELS[:k]])
    same = " and ".join(f"r.{c} is not distinct from o.{c}" for c in ["host", *LEVELS[:k]])
    carried = ", ".join(f"r.{c}" for c in ["host", "path", "pieces", "n", "blocked", "allowed", *LEVELS[:k]])
    return f"""
own{k} as (select *, pieces[{k + 1}] as piece, '*' || regexp_extract(pieces[{k + 1}], '{EXTENSION}', 1) as wild from rows{k}),
totals{k} as (select {above}, sum(n) as total from own{k} where piece is not null group by all),
pieces{k} as (select {above}, piece, sum(n) as n from own{k} where piece is not null group by all),
wilds{k} as (select {above}, wild, sum(n) as n from own{k} where piece is not null group by all),
rows{k + 1} as materialized (
  select {carried},
         case when r.piece is null then null
              when (select p.n * {LITERAL_PARTS} >= o.total and p.n >= {LITERAL_PAGES} from totals{k} o, pieces{k} p where {same} and {same.replace("o.", "p.")} and p.piece = r.piece) then r.piece
              when (select p.n * {LITERAL_PARTS} >= o.total and p.n >= {LITERAL_PAGES} from totals{k} o, wilds{k} p where {same} and {same.replace("o.", "p.")} and p.wild = r.wild) then r.wild
              else '*' end as t{k}
  from own{k} r),"""


def _merge_sql(k: int) -> str:
    parent = ["host", *LEVELS[:k]]
    keys = ", ".join(parent)
    same = lambda a, b: " and ".join(f"{a}.{c} is not distinct from {b}.{c}" for c in parent)
    lower = ", ".join(f"m{j}" for j in range(k + 1, DEPTH))
    below = f"concat_ws('/', {lower})" if lower else "''"
    depth = " + ".join(f"(m{j} is not null)::int" for j in range(k, DEPTH))
    on_pairs = " and ".join(f"x.{c} is not distinct from b.{c}" for c in [*parent])
    return f"""
cells{k} as materialized (
  select {keys}, m{k}, {depth} as depth, {below} as below, s.state, sum(s.c) as c
  from names{k + 1}, unnest([{{'state': 0, 'c': n - blocked - allowed}}, {{'state': 1, 'c': allowed}}, {{'state': 2, 'c': blocked}}]) t(s)
  where m{k} is not null and s.c > 0 group by all),
sizes{k} as materialized (
  select *, row_number() over (partition by {keys} order by b::double / n, a::double / n, m{k}) as place
  from (select {keys}, m{k}, sum(c) as n, sum(case when state = 1 then c else 0 end) as a, sum(case when state = 2 then c else 0 end) as b from cells{k} group by all)),
pairs{k} as (select x.*, y.n as n2, y.m{k} as next from sizes{k} x join sizes{k} y on {same("x", "y")} and y.place = x.place + 1),
both{k} as (
  select {", ".join("p." + c for c in parent)}, p.place, p.n::double as n1, p.n2::double as n2, c.depth, c.below, c.state,
         sum(case when c.m{k} = p.m{k} then c.c else 0 end) as c1, sum(case when c.m{k} = p.next then c.c else 0 end) as c2
  from pairs{k} p join cells{k} c on {same("p", "c")} and (c.m{k} = p.m{k} or c.m{k} = p.next) group by all),
tests{k} as (
  select {keys}, place, sum((c1 * n2 - c2 * n1) * (c1 * n2 - c2 * n1) / (n1 * n2 * (c1 + c2))) as chi, (count(*) - 1)::double as df from both{k} group by all),
alike{k} as (
  select * from tests{k}
  where df = 0 or chi <= df * pow(1.0::double - 2.0::double / (9.0::double * df) + {Z}::double * sqrt(2.0::double / (9.0::double * df)), 3)),
runs{k} as (
  select b.*, sum(case when x.place is null then 1 else 0 end) over (partition by {", ".join("b." + c for c in parent)} order by b.place) as run
  from sizes{k} b left join alike{k} x on {on_pairs} and x.place = b.place - 1),
named{k} as materialized (select {keys}, m{k}, string_agg(m{k}, '|') over (partition by {keys}, run order by m{k} rows between unbounded preceding and unbounded following) as name from runs{k}),
names{k} as materialized (
  select r.* replace (coalesce(x.name, r.m{k}) as m{k}) from names{k + 1} r left join named{k} x on {same("r", "x")} and x.m{k} = r.m{k}),"""


def templates_sql(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    levels, names = ", ".join(LEVELS), ", ".join(f"m{k}" for k in range(DEPTH))
    cut = f"split(regexp_replace(path, '^/', ''), '/')"
    pieces = f"case when path = '' then [] when len({cut}) > {DEPTH} then list_append(list_slice({cut}, 1, {DEPTH - 1}), array_to_string(list_slice({cut}, {DEPTH}, len({cut})), '/')) else {cut} end"
    on = " and ".join(f"p.{c} is not distinct from l.{c}" for c in ["host", *LEVELS])
    same = " and ".join(f"l.{c} is not distinct from j.{c}" for c in ["host", *[f"m{k}" for k in range(DEPTH)]])
    return rf"""
with urls as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '{URL}', 2) as path from pages),
ruled as materialized (select *, {_rules_sql(rules, 0)} as rule, {_rules_sql(rules, 1)} as by_rule from urls),
rows0 as materialized (
  select host, path, {pieces} as pieces, count(*) as n, count(*) filter (by_rule = 'block') as blocked, count(*) filter (by_rule = 'allow') as allowed
  from ruled group by host, path),
{"".join(_level_sql(k) for k in range(DEPTH))}
names{DEPTH} as materialized (
  select host, {levels}, {", ".join(f"{c} as m{k}" for k, c in enumerate(LEVELS))}, sum(n) as n, sum(blocked) as blocked, sum(allowed) as allowed from rows{DEPTH} group by host, {levels}),
{"".join(_merge_sql(k) for k in reversed(range(DEPTH)))}
judged as (
  select host, {names}, '/' || concat_ws('/', {names}) as template, (sum(blocked) + 1) * {REJECT[1]} >= (sum(blocked) + sum(allowed) + 2) * {REJECT[0]} as rejected
  from names0 group by host, {names}),
bad as (
  select p.host, p.path, j.template from rows{DEPTH} p join names0 l on {on} join judged j on {same} where j.rejected)
select r.page_id, r.host, r.path, r.rule, case when r.by_rule is null then b.template end as template,
       coalesce(r.by_rule, case when b.template is null then 'allow' else 'block' end) as verdict
from ruled r left join bad b using (host, path)
"""


SQL = templates_sql()
