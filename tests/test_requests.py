from pyspark.sql import functions as F

from lumenshelf.operators import accessories, audit, lists, requests
from lumenshelf.plans.products import products

RAW = "title string, images array<string>, price double, product_url string, tags array<string>, description string, sub_category string, occasion array<string>, gender string"


def raw(spark, *titles, sub="other", desc=""):
    return spark.createDataFrame([(t, ["i"], 10.0, "https://a.b/c", ["tag"], desc, sub, None, None) for t in titles], RAW)


def test_shoes(spark):
    got = accessories.shoes(raw(spark, "Bridal Velvet Khussa", "Black Pumps", "Leather Thing", "Lawn Suit", sub="sandals")).collect()
    assert [r.shoe_type for r in got[:3]] == ["khussa", "pump", "sandal"]
    assert got[0].occasion == ["wedding", "bridal"] and got[1].primary_color == "Black"
    assert [r.reject for r in got] == [None, None, None, "not a shoe"]


def test_jewelry_and_watches(spark):
    got = accessories.jewelry(raw(spark, "Gold Plated Earrings", "Silver Ring", "Ring Clutch")).collect()
    assert [(r.jewelry_type, r.jewelry_category, r.reject) for r in got] == [("earring", "ear", None), ("ring", "hand", None), ("ring", "hand", "not jewelry")]
    got = accessories.watches(raw(spark, "Structured Dial", "Kurta Watch", desc="Automatic, leather strap, 42mm, 50m")).collect()
    assert (got[0].watch_type, got[0].strap_type, got[0].movement, got[0].water_resistance, got[0].case_diameter_mm, got[0].reject) == ("analog", "leather", "automatic", "50m", 42, None)
    assert got[1].reject == "not a watch"


def test_signals(spark):
    q = spark.createDataFrame([("red wedding lehenga for girls",), ("string lights",), (None,)], "query string")
    a, b, c = requests.signals(q).collect()
    assert (a.colors, a.occasions, a.garments, a.gender_hint, a.strong) == (["Red"], ["wedding"], ["lehenga"], "women", True)
    assert (b.catalog_hints, b.strong, c.colors) == ([], False, [])


def test_intents(spark):
    rows = [("keep it a saree, but the color can change", ["color", "fabric"]), ("Any fabric. I insist on the shade", ["fabric", "color"]), (None, ["color"]), ("the print is flexible", ["print", "color"])]
    got = [r.priority for r in requests.reprioritize(spark.createDataFrame(rows, "feedback string, priority array<string>")).collect()]
    assert got == [["dress_style", "fabric", "color"], ["color", "fabric"], ["color"], ["color", "print"]]
    made = requests.to_intent({"occasion": ["Wedding", ""], "color": "red", "budget": "Rs 5,000", "pieces": "3 piece", "message": "for my kids", "junk": 1})
    assert (made.occasion, made.color_families, made.max_budget, made.pieces, made.gender, made.priority) == (("wedding",), ("Red",), 5000.0, 3, "kids", ())
    given = spark.createDataFrame([(["color", "pieces", "occasion"], ["Wedding"]), (["occasion", "color"], ["casual"]), ([], None)], "given array<string>, occasion array<string>")
    got = [r.p for r in given.select(requests.priority_of(F.col("given"), F.col("occasion")).alias("p")).collect()]
    assert got == [["occasion", "color", "pieces"], ["color", "occasion"], ["occasion", "color", "dress_style"]]


def test_intent_score_and_views(spark):
    p = products(spark, "/root/testdata/sf0.001")
    w = requests.Wish(color="Red", budget=1000, occasion=("party",))
    got = p.withColumn("s", requests.intent_score(w)).agg(F.max("s"), F.min("s"), F.max_by("primary_color", "s")).first()
    assert got[0] > got[1] and got[2] == "Red"
    view = requests.client_view(p.withColumn("piece_type", F.lit("2-piece"))).select("print", "pieces").first()
    assert view["print"] in ("printed", "plain")
    assert requests.compact(p).columns[-1] == "occasion"
    text = p.select(requests.embedding_text({"Color": "primary_color", "Neck": "neckline"}, ["name", F.lit(" ")])).first()[0]
    assert text.count("\n") == 1


def test_quota_window_starts_with_first_hit(spark):
    df = spark.createDataFrame([("a", s) for s in (5, 10, 70, 80, 140)], "caller string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = requests.quota(df, "caller", window_seconds=60, limit=1).orderBy("s").collect()
    assert [(r.n, r.allowed) for r in got] == [(1, True), (2, False), (1, True), (2, False), (1, True)]


def test_intents_as_rows(spark):
    from lumenshelf.operators import intents

    rows = [
        ('{"color": "bottle green", "shade": "mint", "occasion": ["Wedding"], "fabric": "Silk", "pieces": 2, "style": ["x"]}', "silk for men's wedding", None),
        ('{"gender": "men", "piece": "long maxi", "stitching": "null", "print": "weird", "season": "Winter"}', "kurta for my brother", "colour over fabric"),
        ('{"gender": "men", "constraintPriority": ["Season", "season", "x"]}', "a plain kurta", ""),
        ("{broken", "gold jhumka", None),
        (None, None, None),
        ('{"searchCatalog": "Jewellery", "pieces": 2.5, "maxBudget": "5000", "gender": "kids"}', "ring and heels for a toddler", None),
    ]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "id int, raw string, message string, hint string, color string")
    got = intents.intents(df, hint="hint").orderBy("id").collect()
    assert [(r.search_catalog, r.color, r.shade, r.gender, r.pieces) for r in got] == [("clothing", "Green", "mint", "women", 2), ("clothing", "Any", None, "men", None), ("clothing", "Any", None, "women", None), ("jewelry", "Any", None, "women", None), ("clothing", "Any", None, "women", None), ("jewelry", "Any", None, "kids", None)]
    assert [r.priority for r in got] == [["occasion", "color", "pieces", "fabric"], ["color", "fabric"], ["season"], ["occasion"], ["occasion"], ["occasion"]]
    assert (got[1].dress_style, got[1].stitching, got[1].print, got[1].season) == ("maxi", None, None, "winter")
    assert got[0].style == ["x"] and got[3].occasion == ["casual"] and got[3].max_budget == 0 and got[3].summary == "gold jhumka"
    assert intents.intents(df.limit(0)).count() == 0


def test_quota_of_many_hits(spark):
    import random

    rng = random.Random(2)
    hits = [(rng.choice(["a", "b", None]), float(rng.randrange(5000))) for _ in range(3000)]
    df = spark.createDataFrame(hits, "caller string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = requests.quota(df, "caller", window_seconds=60, limit=10).collect()
    for who in ("a", "b", None):
        start, n, want = float("-inf"), 0, []
        for s in sorted(s for c, s in hits if c == who):
            start, n = (s, 1) if s >= start + 60 else (start, n + 1)
            want.append((s, n, n <= 10))
        assert sorted((r.s, r.n, r.allowed) for r in got if r.caller == who) == want


def test_matrix_topk_in_cells(spark):
    import numpy as np

    from lumenshelf.operators import search

    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(500, None, 1), (501, [], 1)], "id long, v array<double>, l int")
    bonus = lambda a, b: 0.1 * (a[:, None] == b[None, :])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    score = np.floor((0.5 * unit @ unit.T + 0.1 * (np.arange(150)[:, None] % 3 == np.arange(150)[None, :] % 3)) * 1000 + 0.5) / 1000
    for cells in ((50_000, 2_000), (40, 7)):
        got = search.matrix_topk(df, df.where("id % 10 = 3 or id > 400"), "id", "v", 4, "l", bonus, cell_rows=cells[0], cell_queries=cells[1]).collect()
        for q in range(3, 150, 10):
            want = sorted((i for i in range(150) if i != q), key=lambda i: (-score[q, i], i))[:4]
            assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
        assert {r.query_id for r in got} == set(range(3, 150, 10))


def test_matrix_topk_scores_few_queries_at_once(spark):
    import numpy as np

    from lumenshelf.operators import search

    def bonus(mine, theirs):
        assert len(mine) * len(theirs) <= 1 << 21
        return np.zeros((len(mine), len(theirs)))

    df = spark.range(2000).selectExpr("id", "array(double(id % 7 + 1), double(id % 11)) AS v", "0 AS l")
    got = search.matrix_topk(df, df, "id", "v", 1, "l", bonus)
    assert got.count() == 2000


def test_every_row_is_a_query_of_pair_scores(spark):
    from lumenshelf.plans import catalog

    sf = "/root/testdata/sf0.001"
    got = catalog.pair_score_topk(spark, sf).groupBy("query_id").count().collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in got} == ids and {r["count"] for r in got} == {3}


def test_audits_are_dealt_to_all_cores(spark):
    one = products(spark, "/root/testdata/sf0.001").coalesce(1).withColumn("tags", F.lit(None).cast("array<string>"))
    assert audit.audited(one, "id").rdd.getNumPartitions() >= 4


def test_first_under_any_price_sorts_nothing_as_a_whole(spark):
    rows = spark.range(120_000).selectExpr("'a' AS l", "(id * 7919) % 120000 AS r", "double((id * 104729) % 5003) AS p").coalesce(1)
    short = lists.first_under_any_price(rows, "l", "r", "p", 2)
    assert "Sort" not in short._jdf.queryExecution().executedPlan().toString()
    lowest, want = [], set()
    for r, p in sorted((x.r, x.p) for x in rows.collect()):
        if len(lowest) < 2 or p < lowest[-1]:
            want.add((r, p))
            lowest = sorted([*lowest, p])[:2]
    assert {(x.r, x.p) for x in short.collect()} == want
