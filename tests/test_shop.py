"""Probes, audits and other operations of a shop's catalog, on small rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from lumenshelf.operators import audit, probes, recommend
from lumenshelf.operators.filters import Intent
from lumenshelf.plans import shop

GARMENTS = "id long, name string, sub_category string, in_stock boolean, gender string, price double, dress_style string, fabric string, occasion array<string>, primary_color string, colors array<string>, exact_colors array<string>"


@pytest.fixture(scope="module")
def garments(spark):
    rows = []
    for i, (style, fabric, occasion, tone) in enumerate(itertools.product(["lehenga", "kurta", None], ["lawn", "silk"], ["party", "office"], ["Red", "Blue", "Green"])):
        rows.append((i, f"item {i}", "suit", i % 9 != 0, "women", 100.0 * (i % 7 + 1), style, fabric, [occasion], tone, [tone], [tone.lower()]))
    return spark.createDataFrame(rows, GARMENTS)


WISH = Intent(dress_style="lehenga", fabric="lawn", occasion=("party",), color_exact="red", color_families=("Red",), max_budget=300)


def brute_counts(df, intent):
    soft = recommend.soft(intent)
    rows = df.where(recommend.hard(intent, budget=False)).select("price", *(c.alias(n) for n, c in soft.items())).collect()
    out = {}
    for k in range(len(soft) + 1):
        for dropped in itertools.combinations(soft, k):
            found = [r["price"] for r in rows if all(r[n] for n in soft if n not in dropped)]
            if found:
                out[frozenset(dropped)] = (sum(p <= intent.max_budget for p in found), len(found), min(found))
    return out


def test_probes_of_every_combination(garments):
    got = {frozenset(r.dropped): (r.n, r.lifted, r.cheapest) for r in probes.probes(garments, WISH).collect()}
    assert got == brute_counts(garments, WISH) and len(got) > 10
    assert probes.probes(garments.limit(0), WISH).count() == 0
    assert [r.dropped for r in probes.probes(garments, Intent()).collect()] == [[]]


def test_probes_scan_once(spark):
    plan = shop.relax_probes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def scripted(*moves):
    left = list(moves)
    return lambda offer: left.pop(0) if left else None


def test_planner_loop(garments):
    counts = probes.Counts(garments, WISH)
    seen = []

    def greedy(offer):
        seen.append(offer)
        best = max(offer.options, key=offer.options.get)
        return probes.Move("relax", best)

    out = probes.plan(garments, WISH, greedy, least=4)
    assert out.choice.level is not None and counts.at(out.choice.level.dropped, out.choice.level.color)[0] >= 4
    assert garments.where(recommend.level_filter(WISH, out.choice.level)).count() == counts.at(out.choice.level.dropped, out.choice.level.color)[0]
    assert seen[0].options["lawn"] == counts.at(["fabric"], "exact")[0] and seen[0].lifted == counts.at([], "exact")[1]
    # a distinctive style stays while anything else can go
    style = Intent(dress_style="lehenga", fabric="silk", occasion=("office",))
    out = probes.plan(garments, style, lambda offer: probes.Move("relax", "lehenga"), least=20)
    assert out.choice.relaxed == ("occasion", "fabric") and counts.at([], "exact") is not None
    # a planner that gives up too early is overruled while something would help
    out = probes.plan(garments, WISH, lambda offer: probes.Move("accept", message="fine"), least=4)
    n = counts.at(out.choice.level.dropped, out.choice.level.color)[0] if out.choice.level else 0
    assert out.choice.relaxed or n == 0
    # no planner: the ladder
    assert probes.plan(garments, WISH, scripted(), least=4).choice == recommend.choose(garments, WISH, 4)
    # the budget
    poor = Intent(dress_style="lehenga", max_budget=50)
    out = probes.plan(garments, poor, scripted(probes.Move("raise_budget", message="more")), least=1)
    assert out.choice.level is None and out.choice.budget_block == (50, counts.at(["fabric", "occasion"], "none")[2]) and out.message == "more"
    assert probes.planned(garments, poor, scripted(probes.Move("raise_budget")), 1).count() == 0
    # nothing at all: never a message that sounds like a result
    none = Intent(dress_style="saree", fabric="wool")
    assert probes.plan(garments, none, lambda o: probes.Move("accept", message="here you are")).message == probes.NOTHING
    # words that name no constraint: the next one in order goes
    out = probes.plan(garments, Intent(occasion=("gala",), fabric="lawn"), scripted(probes.Move("relax", "???")), least=1)
    assert out.choice.relaxed == ("occasion",)


LISTING = "id long, name string, description string, fabric string, exact_colors array<string>, colors array<string>, primary_color string, pieces int, stitching string, gender string, tags array<string>"


def listing(spark, *rows):
    names = [f.split()[0] for f in LISTING.replace("array<string>", "a").split(", ")]
    return spark.createDataFrame([tuple({"id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], LISTING)


def found(df, check):
    out = {r.id: [] for r in df.collect()}
    for r in audit.audited(df, "id", check).collect():
        out[r.id].append((r.severity, r.type))
    return [sorted(out[i]) for i in sorted(out)]


def test_consistency_rules(spark):
    df = listing(
        spark,
        {"fabric": "Lawn", "description": "Fabric: Lawn Color: Red"},
        {"fabric": "Cotton Silk", "description": "Fabric: Yarn Dyed Cotton Silk. Fit: loose"},
        {"fabric": "Yarn Woven Silk", "description": "Fabric: Digital Silk."},
        {"fabric": "Rawsilk", "description": "Fabric: Korean Raw Silk"},
        {"fabric": "Khaddar", "description": "Fabric: Chiffon. Dupatta Fabric: Net."},
        {"fabric": "Khaddar", "description": "Fabric: Chiffon. Dupatta Fabric: Khaddar."},
        {"exact_colors": ["red"], "description": "Color: Peacock Blue"},
        {"exact_colors": ["pink"], "description": "Color: Blue. Color: Candlelight Pink."},
        {"exact_colors": ["red"], "description": "Color: Digital Print"},
        {"exact_colors": [], "description": "Color: Blue"},
        {"pieces": 3, "name": "Lawn 2-Piece Suit"},
        {"pieces": 2, "name": "Two-Piece Suit", "description": "1 PC Embroidered Front, 3 PC Border"},
        {"pieces": 2, "description": "Unstitched 3 Pcs. Embroidered"},
        {"stitching": "stitched", "name": "Unstitched Suit"},
        {"stitching": "semi-stitched", "name": "Unstitched Suit"},
        {"gender": "women", "name": "Men's Kurta"},
        {"gender": "women", "name": "Men's and Women's Kurta"},
        {"gender": "men", "description": "for ladies"},
        {},
        {"fabric": "", "description": "", "name": "", "exact_colors": [None], "pieces": 0},
    )
    hard, soft = lambda t: [("hard", t)], lambda t: [("soft", t)]
    want = [[], [], soft("FABRIC"), [], hard("FABRIC"), [], soft("COLOR"), [], [], [], hard("PIECE_COUNT"), [], hard("PIECE_COUNT"), hard("STITCHED_TYPE"), [], soft("GENDER"), [], soft("GENDER"), [], []]
    assert found(df, audit.consistency) == want
    repair = df.withColumn("issues", audit.consistency()).where(audit.needs_repair())
    assert sorted(r.id for r in repair.collect()) == [4, 10, 12, 13]
    details = {r.id: r.detail for r in audit.audited(df, "id").collect()}
    assert details[10] == "field 3, text 2" and "Chiffon" in details[4]
    assert {(r.type, r.severity, r.n) for r in audit.rates(df).collect()} == {("FABRIC", "soft", 1), ("FABRIC", "hard", 1), ("COLOR", "soft", 1), ("PIECE_COUNT", "hard", 2), ("STITCHED_TYPE", "hard", 1), ("GENDER", "soft", 2)}


def test_overlap_rules(spark):
    df = listing(
        spark,
        {"fabric": "Cotton Net", "description": "Fabric: Soft Net Material: x"},
        {"fabric": "Lawn", "description": "fabric: velvet"},
        {"pieces": 3, "name": "Suit", "description": "2 pc set"},
        {"stitching": "stitched", "name": "Lawn RTS"},
        {"gender": "men", "description": "for ladies"},
        {"primary_color": "Red", "colors": ["Red"], "description": "Colour: Navy Blue"},
        {"primary_color": "Red", "colors": ["Blue"], "description": "Color: Navy"},
        {"primary_color": "Red", "description": "Color: Digital Printed"},
        {"primary_color": "Red", "description": "Color: Wobbly"},
        {},
    )
    one = lambda t: [("audit", t)]
    assert found(df, audit.overlap) == [[], one("FABRIC"), one("PIECE_COUNT"), one("STITCHED_TYPE"), [], one("COLOR"), [], [], [], []]


def test_shoes_of_another_gender(spark):
    df = listing(spark, {"gender": "women", "name": "Men's Loafer"}, {"gender": "women", "name": "Pump", "tags": ["B20-Girl B", "girls"]}, {"gender": "women", "name": "Pump", "tags": ["B20-Girl B"]}, {"gender": "women", "name": "Women and Girls Pump"}, {})
    assert found(df, audit.shoe_gender) == [[("audit", "GENDER")], [("audit", "GENDER")], [], [], []]


# --- outfits and accessories ---------------------------------------------------------------------------------------------


def test_short_lists_serve_every_price_limit(spark):
    import random

    from lumenshelf.operators.lists import first_under_any_price

    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, float(rng.randrange(50))])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, id long, price double").repartition(5)
    few = [(r.k, r.id, r.price) for r in first_under_any_price(df, "k", "id", "price", 3).collect()]
    assert len(few) < 120
    for k in "ab":
        for limit in [*range(-1, 51), float("inf")]:
            want = sorted(i for x, i, p in rows if x == k and (limit == float("inf") or (p is not None and p <= limit)))[:3]
            got = sorted(i for x, i, p in few if x == k and (limit == float("inf") or (p is not None and p <= limit)))[:3]
            assert got == want
    assert first_under_any_price(df.limit(0), "k", "id", "price", 3).count() == 0


OUTFIT = "id long, name string, gender string, price double, primary_color string, occasion array<string>, includes array<string>, sub_category string, dress_style string, fashion_type string, pieces string"


def test_outfit_rules(spark):
    from lumenshelf.operators import outfits

    def row(i, **x):
        names = [f.split()[0] for f in OUTFIT.split(", ")]
        return tuple({"id": i, "gender": "women", "price": 100.0, "primary_color": "Red", "occasion": ["party"], **x}.get(n) for n in names)

    pool = [
        row(1, sub_category="dupatta"), row(2, sub_category="dupatta", primary_color="Blue"), row(3, sub_category="dupatta", occasion=["Party"], price=141.0), row(4, sub_category="dupatta", gender="unisex"),
        row(5, sub_category="pants"), row(6, sub_category="shalwar", occasion=None), row(7, dress_style="trouser"), row(8, name="Wide Jeans"), row(9, sub_category="dupatta", gender="men"),
    ]
    heroes = [
        row(20, fashion_type="western", dress_style="top"), row(21, pieces="2-piece", includes=["shirt", "trouser"]), row(22, includes=["Kameez", "Dupatta"]), row(23, pieces="1-piece"), row(24, sub_category="kurta", pieces="2-piece", price=None),
        row(25, fashion_type="western", dress_style="top", gender="men"), row(26, pieces="3-piece"), row(27, pieces="1-piece", gender=None, occasion=None, primary_color=None),
    ]
    df = spark.createDataFrame([*pool, *heroes], OUTFIT)
    got = {}
    for r in outfits.complete(df, df.where("id >= 20"), "id").orderBy("hero_id", "place").collect():
        got.setdefault(r.hero_id, []).append((r.slot, r.id, r.score))
    assert got == {
        20: [("western_bottom", 7, 3), ("western_bottom", 8, 3)],
        21: [("dupatta_two", 1, 3), ("dupatta_two", 4, 3)],
        22: [("bottom_set", 5, 3), ("bottom_set", 7, 3)],
        23: [("dupatta_one", 1, 3), ("bottom_one", 5, 3)],
        24: [("dupatta_two", 1, 3), ("dupatta_two", 3, 3), ("dupatta_one", 1, 3), ("bottom_one", 5, 3)],
        27: [("dupatta_one", 1, 0), ("bottom_one", 5, 0)],
    }
    only = outfits.complete(df, df.where("id = 23"), "id", focus=("bottom_eastern",)).collect()
    assert [(r.slot, r.role) for r in only] == [("bottom_one", "bottom")] and only[0].advice
    assert outfits.complete(df, df.where("id = 23"), "id", focus=("none",)).count() == 0
    assert outfits.complete(df.limit(0), df.limit(0), "id").count() == 0


def test_jewelry_and_watch_picks(spark):
    from lumenshelf.operators import extras

    schema = "id long, primary_color string, colors array<string>, occasion array<string>, jewelry_type string, watch_type string, dial_color string"
    dress = spark.createDataFrame([(1, "Red", ["Black"], ["wedding"], None, None, None), (2, None, None, None, None, None, None)], schema).withColumnRenamed("id", "dress")
    rows = [(i, "Gold", None, ["wedding"], kind, None, None) for i, kind in enumerate(["jhumka", "jhumka", "jhumka", "ring", "choker", "stud", "anklet", None])]
    items = spark.createDataFrame(rows, schema).withColumnRenamed("id", "item")
    pick = lambda *a: {k: [(r.kind, r.item) for r in sorted(g, key=lambda r: r.place)] for k, g in itertools.groupby(sorted(extras.jewelry_sets(dress, items, "dress", "item", *a).collect(), key=lambda r: r.dress), key=lambda r: r.dress)}
    assert pick(("wedding",))[1] == [("jhumka", 0), ("jhumka", 1), ("choker", 4), ("ring", 3), ("stud", 5)]  # the first two, then other kinds
    assert pick(("office",), ("minimal_jewelry",))[1] == [("stud", 5), ("ring", 3)]  # at most two, small ones first
    assert len(pick(("office",))[1]) == 3 and len(pick(("wedding",))[2]) == 5
    assert extras.set_size(("office",), ("statement_jewelry",)) == 5 and extras.set_size(("Eid",), ("minimal_jewelry",)) == 2
    clocks = spark.createDataFrame([(1, "Black", None, ["casual"], None, "sports", None), (2, "Black", None, ["wedding"], None, "dress", None), (3, "Black", None, ["wedding"], None, "dress", "Gold")], schema).withColumnRenamed("id", "item")
    best = lambda *o: {r.dress: r.item for r in extras.watches(dress, clocks, "dress", "item", o).collect()}
    assert best("wedding")[1] == 2 and best("casual")[1] == 1 and set(best()) == {1, 2}
    assert extras.watches(dress, clocks.limit(0), "dress", "item", ("casual",)).count() == 0


def test_accessory_searches(spark):
    from lumenshelf.operators import extras

    schema = "id long, price double, in_stock boolean, gender string, primary_color string, occasion array<string>, shoe_type string, watch_type string"
    rows = [(1, 50.0, True, "women", "Red", ["party"], "heel", "sports"), (2, 60.0, None, "unisex", "Blue", None, "pump", "dress"), (3, 70.0, True, "women", "Red", ["office"], "flat", "dress"), (4, 500.0, True, "women", "Red", ["party"], "heel", None), (5, 10.0, False, "women", "Red", ["party"], "heel", None), (6, 20.0, True, "men", "Red", ["party"], "heel", "sports")]
    df = spark.createDataFrame(rows, schema)
    ask = lambda **x: [(r.id, r.score, r.relaxed) for r in extras.only(df, extras.Wish(gender="women", max_budget=100, **x), "shoes", "id").orderBy("rank").collect()]
    assert ask(kind="Heels", color="Red", occasion=("party",)) == [(1, 6, None)]
    assert ask(kind="Heels", color="Green", occasion=("party",)) == [(1, 3, "colour"), (2, 1, "colour")]
    assert ask(kind="boots", occasion=("party",)) == [(1, 3, "boots"), (2, 1, "boots"), (3, 1, "boots")]
    assert ask() == [(1, 1, None), (2, 1, None), (3, 1, None)] and extras.only(df.limit(0), extras.Wish(), "shoes", "id").count() == 0
    ids = lambda **x: sorted(r.id for r in extras.pool(df, "watches", x.get("types", []), "watch_type", "women", 50).collect())
    assert ids(types=["sports"]) == ids() == [1, 2]  # 1.35 x 50 = 67.5; too few of the type


def test_widening_and_smoke(spark):
    from lumenshelf.operators import search, smoke

    rows = [("a", i, i >= 16) for i in range(1, 100)] + [("b", i, i == 2) for i in range(1, 8)] + [("c", i, False) for i in range(1, 200)] + [("d", i, i in (1, 40, 59)) for i in range(1, 90)]
    got = {}
    for r in search.widen(spark.createDataFrame(rows, "g string, r int, ok boolean"), "g", "r", F.col("ok"), want=3).collect():
        got.setdefault((r.g, r.round, r.pool), []).append(r.r)
    assert {k: sorted(v) for k, v in got.items()} == {("a", 2, 30): [16, 17, 18], ("b", 1, 7): [2], ("d", 3, 60): [1, 40, 59]}
    top = search.presorted(spark.range(100), F.col("id") % 50, -F.col("id"), "id", keep=4, limit=3)
    assert [(r.id, r.rank) for r in top.orderBy("rank").collect()] == [(48, 1), (49, 2), (98, 3)]
    found = spark.createDataFrame([(1, True, "shoes"), (2, None, "jewelry")], "position int, in_stock boolean, catalog string")
    out = smoke.check(spark, [smoke.Search("fine", found, "shoes"), smoke.Search("other", found, "jewelry"), smoke.Search("empty", found.limit(0)), smoke.Search("sold", found.withColumn("in_stock", F.lit(False)))])
    assert {(r.search, r.problem) for r in out.collect()} == {("other", "wrong catalog"), ("empty", "no results"), ("sold", "sold out")}


def test_query_texts_and_photos(spark):
    from lumenshelf.functions import text
    from lumenshelf.operators import evaluate, search

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    prompt = lambda t, s=None: one(text.search_prompt(F.lit(t), F.lit(s).cast("string")))
    assert prompt("pastel pink or mint green 3-piece") == "pastel pink 3-piece"
    assert prompt("red or blue shoes") == "red or blue shoes"  # no known word behind
    assert prompt("anarkali-style shalwar-kameez") == "shalwar-kameez" and prompt("a Gown", None) == "a Gown"
    assert prompt("western maxi dress for dinner", "western") == "western for dinner" and prompt("long frock", "co-ord") == "co-ord"
    photo = lambda c, *k: one(search.photo_catalog(F.lit(c), F.array(*(F.lit(x) for x in k))))
    assert [photo("Khussas"), photo("x", "nose pin"), photo("smartwatch"), photo("kurta", "lawn")] == ["shoes", "jewelry", "watches", "clothing"]
    assert one(search.photo_colors(F.lit("teal with navy and gold"))) == ["Teal", "Blue"] and one(search.photo_colors(F.lit("printed"))) == []
    assert one(search.photo_colors(F.lit("dusty pink trim on ivory"), "shades")) == ["dusty pink", "ivory"]
    schema = "id int, description string, tags array<string>, gender string, piece_type string, stitching string, dress_style string, pattern string, includes array<string>, pieces int, metadata_score double"
    long = "a description of some length"
    rows = [(1, long, None, "women", "2-piece", "stitched", "kurta", "plain", ["a", "b"], 2, 0.9), (2, long, None, None, None, "stitched", "kurta", "plain", ["a", "b"], 2, 0.9), (3, long, None, "women", "3-piece", "stitched", "kurta", "plain", ["a", "b"], 3, 0.9), (4, "short", ["x"], None, None, None, None, None, None, None, None), (5, long, None, "women", "suit", "stitched", "kurta", "plain", ["a"], 1, 0.3), (6, "short", ["a tag", "another long tag"], "women", "suit", "stitched", "kurta", "plain", None, 1, 0.9)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in df.where(evaluate.needs_refinement()).collect()) == [2, 3, 5, 6]
