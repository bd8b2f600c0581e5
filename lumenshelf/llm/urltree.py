"""URL filters: rules by host and path, and a path-template tree for what no rule covers. DataFrame functions only.

Per host, the segments of paths grow a tree, level by level. At each node, segments that vary (that hold a digit, or whose
node has many distinct ones, mostly seen once or twice) become the wildcard `*`, their file extension kept; what lies
deeper than LEVELS segments is one `**`. Pages that rules cover are the labelled ones.

Sibling templates with at least SURE labelled pages are set in the order of their blocked shares, and each is tested against the
one before it: those that don't differ significantly are one branch, with their labels together. A branch's blocked share is
smoothed towards that of the same template on all hosts, this one towards the share of the siblings together, then the host's,
then that of all labelled pages, so a template without labels of its own is judged by the nearest level that has some. Above
one half it is rejected.

Results: url null or without `://`: host and path empty, no rule, judged by the method's prior. Every page has a verdict.
`basis` tells the nearest level with labels: rule, branch, template, siblings, host or prior. Repeated rows and null ids are
judged like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

LEVELS = 8
MANY, VARIED = 16, 0.5
SURE = 8  # labelled pages; with as many, none and all of them blocked differ
STRENGTH, Z = 2.0, 1.96
HOSTS, HOT = 1000, 1000
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def templates(paths: DataFrame, store: Scratch) -> DataFrame:
    """paths: host, path (each pair once) and n, the pages of it. Adds `template`, `parent`, and `salts` and `salt` as below. Each
    level is written, as the next one reads it twice; there are as many as the deepest path needs, LEVELS at most.

    Each level joins a host's paths with what is known of its nodes. Hosts with at least 1/HOSTS of all paths, of which there
    are no more than HOSTS, are dealt by path too, in shares of about that many, so they don't come to one task."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    total, deepest = paths.agg(F.count(F.lit(1)), F.max(F.size(parts))).first()
    share = max(HOT, total // HOSTS)
    hosts = paths.groupBy("host").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= share).select("host", F.ceil(F.col("k") / share).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    now = paths.join(F.broadcast(hosts), "host", "left").withColumns({"parts": parts, "template": F.lit(""), "parent": F.lit(""), "salts": salts, "salt": F.pmod(F.xxhash64("path"), salts).cast("int")})
    for level in range(min(LEVELS, deepest or 0)):
        now = now.withColumn("seg", F.get("parts", F.lit(level)))
        leaves = now.where(F.col("seg").isNotNull()).groupBy("host", "template", "seg").agg(F.sum("n").alias("seg_n"), F.max("salts").alias("s"))
        nodes = leaves.groupBy("host", "template").agg(F.count(F.lit(1)).alias("distinct"), F.sum("seg_n").alias("pages"), F.max("s").alias("s"))
        nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).drop("s")
        varied = (F.col("distinct") >= MANY) & (F.col("distinct") >= VARIED * F.col("pages"))
        general = F.when(F.col("seg").rlike("[0-9]") | varied, F.concat(F.lit("*"), F.regexp_extract("seg", r"(\.[A-Za-z]+)$", 1))).otherwise(F.col("seg"))
        now = now.join(nodes, ["host", "template", "salt"], "left").withColumn("next", F.concat("template", F.lit("/"), general))
        deeper = F.col("seg").isNotNull()
        now = now.withColumns({"parent": F.when(deeper, F.col("template")).otherwise(F.col("parent")), "template": F.when(deeper, F.col("next")).otherwise(F.col("template"))}).drop("distinct", "pages", "next", "seg")
        now = store.keep(now)
    more = F.size("parts") > LEVELS
    now = now.withColumns({"parent": F.when(more, F.col("template")).otherwise(F.col("parent")), "template": F.when(more, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))})
    return now.drop("parts")


def branches(labels: DataFrame) -> DataFrame:
    """labels: host, parent, template, n and b, its labelled and blocked pages. Of those with SURE labels or more, (host, parent, n, b,
    branch_n, branch_b): what the branch has that templates of n and b are merged into.

    Siblings of equal n and b are alike, so they are counted first. What is left to order in a parent has distinct n and b, and
    w labelled pages have fewer than 2 * w ** (2 / 3) of these: far fewer than it has pages or templates."""
    alike = labels.where(F.col("n") >= SURE).groupBy("host", "parent", "n", "b").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("host", "parent").orderBy(F.col("b") / F.col("n"), "n", "b")
    last = alike.withColumns({"ln": F.lag("n").over(order), "lb": F.lag("b").over(order)})
    both = (F.col("b") + F.col("lb")) / (F.col("n") + F.col("ln"))
    gap = F.col("b") / F.col("n") - F.col("lb") / F.col("ln")
    parted = gap * gap > Z * Z * both * (1 - both) * (F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("ln"))
    cut = last.withColumn("branch", F.sum(F.coalesce(parted, F.lit(False)).cast("int")).over(order))
    whole = Window.partitionBy("host", "parent", "branch")
    sums = {f"branch_{x}": F.sum(F.col("m") * F.col(x)).over(whole) for x in ("n", "b")}
    return cut.withColumns(sums).select("host", "parent", "n", "b", "branch_n", "branch_b")


def _elsewhere(labels: DataFrame) -> DataFrame:
    """Adds gn and gb: the labelled and blocked pages of the template on all hosts. Templates of at least 1/HOSTS of the rows, of which
    there are no more than HOSTS, are broadcast; the others meet by a shuffle."""
    of_all = labels.groupBy("template").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("gn"), F.sum("b").alias("gb"))
    share = max(HOT, labels.count() // HOSTS)
    hot, rare = F.broadcast(of_all.where(F.col("k") >= share).drop("k")), of_all.where(F.col("k") < share).drop("k")
    return labels.join(hot, "template").unionByName(labels.join(hot, "template", "left_anti").join(rare, "template"))


def _dealt(df: DataFrame) -> DataFrame:
    """A copy of each row for each share of its host."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def purity(paths: DataFrame, store: Scratch) -> DataFrame:
    """paths: host, parent, template, salts, n_given and n_blocked. (host, parent, template, salts, purity, basis)."""
    labels = paths.groupBy("host", "parent", "template").agg(F.sum("n_given").alias("n"), F.sum("n_blocked").alias("b"), F.max("salts").alias("salts"))
    labels = store.keep(labels.withColumn("salt", F.pmod(F.xxhash64("template"), F.col("salts")).cast("int")))
    pooled = labels.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.max("salts").alias("salts"))
    of_host = pooled.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("pb").alias("hb"))
    merged = branches(labels).join(pooled.select("host", "parent", "salts"), ["host", "parent"])
    blocked, labelled = labels.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    around = _elsewhere(labels).join(_dealt(pooled.join(of_host, "host")), ["host", "parent", "salt"])
    known = around.join(_dealt(merged), ["host", "parent", "n", "b", "salt"], "left")
    rate = F.lit((blocked + 0.5) / (labelled + 2))
    for b, n in [("hb", "hn"), ("pb", "pn"), ("gb", "gn"), (F.coalesce("branch_b", "b"), F.coalesce("branch_n", "n"))]:
        b, n = (F.col(x) if isinstance(x, str) else x for x in (b, n))
        rate = (b + STRENGTH * rate) / (n + STRENGTH)
    basis = F.when(F.col("n") > 0, "branch").when(F.col("gn") > 0, "template").when(F.col("pn") > 0, "siblings").when(F.col("hn") > 0, "host").otherwise("prior")
    return known.select("host", "parent", "template", "salts", rate.alias("purity"), basis.alias("basis"))


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """All columns, with host, path, rule, verdict, template, purity (the template's smoothed blocked share) and basis. Columns of
    these names are replaced. The tree is grown over distinct addresses, and joined back to the pages once."""
    host, path = host_and_path(url)
    kept = df.drop("host", "path", "rule", "verdict", "template", "purity", "basis")
    (given,) = fresh(kept, "_given")
    parsed = kept.withColumns({"host": host, "path": path})
    rule, what = _rule(rules)
    parsed = parsed.withColumns({"rule": rule, given: what})
    store = Scratch(df.sparkSession, "urltree")
    paths = store.keep(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count(given).alias("n_given"), F.count(F.when(F.col(given) == "block", 1)).alias("n_blocked")))
    tree = templates(paths, store)
    rates = _dealt(purity(tree, store))
    found = store.finish(tree.join(rates, ["host", "parent", "template", "salt"], "left").select("host", "path", "template", "purity", "basis"))
    judged = parsed.join(found, ["host", "path"], "left")
    verdict = F.coalesce(given, F.when(F.col("purity") > 0.5, "block").otherwise("allow"))
    return judged.select(*(F.col(f"`{c}`") for c in kept.columns), "host", "path", "rule", verdict.alias("verdict"), "template", "purity", F.when(F.col(given).isNotNull(), "rule").otherwise(F.col("basis")).alias("basis"))


def _level(k: int) -> str:
    return f"""
leaf{k} AS (SELECT host, template, list_extract(parts, {k + 1}) AS seg, count(*) AS n FROM t{k} WHERE len(parts) > {k} GROUP BY ALL),
node{k} AS (SELECT host, template, count(*) AS d, sum(n) AS pages FROM leaf{k} GROUP BY ALL),
t{k + 1} AS (
  SELECT page_id, t.host, path, rule, given, parts,
    CASE WHEN len(parts) > {k} THEN t.template || '/' || CASE
      WHEN regexp_matches(parts[{k + 1}], '[0-9]') OR (d >= {MANY} AND d >= {VARIED} * pages)
      THEN '*' || regexp_extract(parts[{k + 1}], '(\\.[A-Za-z]+)$', 1) ELSE parts[{k + 1}] END ELSE t.template END AS template,
    CASE WHEN len(parts) > {k} THEN t.template ELSE parent END AS parent
  FROM t{k} t LEFT JOIN node{k} x ON x.host = t.host AND x.template = t.template),"""


def _case(rules: list[tuple[str, str, str]], what: int) -> str:
    whens = []
    for r in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        value = r[0] + r[1] if what == 0 else r[2]
        whens.append(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{value}'")
    return f"CASE {' '.join(whens)} END"


SQL = f"""
WITH raw AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
t0 AS (SELECT *, {_case(RULES, 0)} AS rule, {_case(RULES, 1)} AS given,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS parts, '' AS template, '' AS parent FROM parsed),
{"".join(_level(k) for k in range(LEVELS))}
done AS (SELECT page_id, host, path, rule, given,
  CASE WHEN len(parts) > {LEVELS} THEN template || '/**' ELSE template END AS template,
  CASE WHEN len(parts) > {LEVELS} THEN template ELSE parent END AS parent FROM t{LEVELS}),
labelled AS (SELECT host, parent, template, count(given) AS n, count(*) FILTER (given = 'block') AS b FROM done GROUP BY ALL),
prior AS (SELECT (coalesce(sum(b), 0) + 0.5) / (coalesce(sum(n), 0) + 2) AS prior FROM labelled),
pooled AS (SELECT host, parent, sum(n) AS pn, sum(b) AS pb FROM labelled GROUP BY ALL),
hosts AS (SELECT host, sum(pn) AS hn, sum(pb) AS hb FROM pooled GROUP BY ALL),
elsewhere AS (SELECT template, sum(n) AS gn, sum(b) AS gb FROM labelled GROUP BY ALL),
alike AS (SELECT host, parent, n, b, count(*) AS m FROM labelled WHERE n >= {SURE} GROUP BY ALL),
last AS (SELECT *, lag(n) OVER w AS ln, lag(b) OVER w AS lb FROM alike WINDOW w AS (PARTITION BY host, parent ORDER BY b / n, n, b)),
tested AS (SELECT *, b / n - lb / ln AS gap, (b + lb) / (n + ln) AS both_share FROM last),
cut AS (SELECT *, sum(CASE WHEN gap * gap > {Z} * {Z} * both_share * (1 - both_share) * (1.0 / n + 1.0 / ln) THEN 1 ELSE 0 END)
  OVER (PARTITION BY host, parent ORDER BY b / n, n, b) AS branch FROM tested),
branches AS (SELECT host, parent, n, b, sum(m * n) OVER w AS branch_n, sum(m * b) OVER w AS branch_b FROM cut WINDOW w AS (PARTITION BY host, parent, branch)),
levels AS (SELECT l.*, pn, pb, gn, gb, coalesce(branch_n, l.n) AS bn, coalesce(branch_b, l.b) AS bb, (hb + {STRENGTH} * prior) / (hn + {STRENGTH}) AS host_share
  FROM labelled l JOIN pooled USING (host, parent) JOIN hosts USING (host) JOIN elsewhere USING (template)
  LEFT JOIN branches x ON x.host = l.host AND x.parent = l.parent AND x.n = l.n AND x.b = l.b, prior),
purity AS (SELECT *, (bb + {STRENGTH} * ((gb + {STRENGTH} * ((pb + {STRENGTH} * host_share) / (pn + {STRENGTH}))) / (gn + {STRENGTH}))) / (bn + {STRENGTH}) AS purity FROM levels)
SELECT page_id, d.host, path, rule, coalesce(given, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM done d LEFT JOIN purity p ON p.host = d.host AND p.parent = d.parent AND p.template = d.template
"""
