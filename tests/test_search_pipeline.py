"""The search pipeline, stored index, outbox and feeds on small fixtures against plain Python."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stallwright.functions import scoring as C
from stallwright.functions import text as T
from stallwright.functions.text import osa_distance
from stallwright.operators import candidates as N
from stallwright.operators import experiments as X
from stallwright.operators import listing as L
from stallwright.operators import pipeline as P
from stallwright.operators import scans as Z
from stallwright.operators import search as S
from stallwright.operators import understand as U
from stallwright.operators.index import SearchIndex
from stallwright.sources.feed import feed_rows, read_feed_exact, read_synonyms
from stallwright.storage import RowStore, scratch
from stallwright.streaming.outbox import Outbox, work_index_queue

DAY = dt.datetime(2025, 11, 20)
COLUMNS = "product_id string, name string, brand_name string, category_path string, sku_text string, tag_text string, attribute_text string, description_text string, price_paise bigint, compare_at_paise bigint, status string, is_searchable boolean, rating_average double, rating_count bigint, popularity double, indexed_at timestamp"


def product(key, name, brand="Acme", path="home/mugs", sku="SK-1", tags="gift", attributes="red m", text="A thing.", price=50_000, before=None, status="ACTIVE", found=True, stars=4.0, ratings=10, liked=5.0):
    return (key, name, brand, path, sku, tags, attributes, text, price, before, status, found, stars, ratings, liked, DAY)


ITEMS = [
    product("p1", "Red Mug"), product("p2", "Red Mug Large", "Other", price=150_000, before=200_000), product("p3", "Blue Mug", attributes="blue s", stars=None, ratings=0), product("p4", "Red Lamp", path="home/lamps", status="DISCONTINUED"),
    product("p5", "Teapot", tags="red mug", liked=90.0), product("p6", "Red Mug", found=False), product("p7", "Astronaut Poster", None, None, "AB12345", "", "", ""),
]


def catalog(spark, rows=ITEMS):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex(spark).upsert(catalog(spark))


def plans(spark, index, *queries):
    entries = U.lexicon(catalog(spark), spark.createDataFrame([("blue",)], "slug string")).cache()
    return U.plan_queries(spark.createDataFrame([(q,) for q in queries], "query string"), index.vocabulary(), U.synonym_table(spark), entries)


def found(spark, index, rows, **how):
    own = plans(spark, index, *{q for q, _ in rows})
    requests = P.requests_of(spark.createDataFrame(rows, "query string, filters string"), own)
    now = spark.createDataFrame([(DAY,)], "now timestamp")
    return P.candidates(requests, index), requests, own, now


def listed(results):
    return [r.product_id for r in sorted(results.collect(), key=lambda r: r["rank"])]


def test_index_follows_changes(spark):
    index = SearchIndex(spark).upsert(catalog(spark, ITEMS[:4]))
    index.upsert(catalog(spark, [product("p1", "Green Mug"), *ITEMS[4:]])).remove(spark.createDataFrame([("P2 ",), ("nothing",), (None,)], "product_id string"))
    want = S.vocabulary(S.postings(catalog(spark, [product("p1", "Green Mug"), *ITEMS[2:]])))
    assert {tuple(r) for r in index.vocabulary().collect()} == {tuple(r) for r in want.select("term", "df", "tf").collect()}
    assert index.size == 6 and index.vocabulary_size == want.count()
    again = SearchIndex(spark, index.path).prune(spark.createDataFrame([("p1",), ("p3",)], "product_id string"))
    assert again.size == 2 and {r.product_id for r in again.rows.read().collect()} == {"p1", "p3"}
    again.reindex(catalog(spark, [product("p1", "Black Mug"), product("p9", "Black Pen", path="desk")]), category_path="home")
    assert again.size == 2 and again.vocabulary().filter("term = 'black'").first().df == 1
    assert again.upsert(catalog(spark, [])).size == 2


def test_index_change_that_was_cut_off_is_done_again(spark, monkeypatch):
    index = SearchIndex(spark).upsert(catalog(spark, ITEMS[:2]))
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(RowStore, "apply", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        index.upsert(catalog(spark, ITEMS[2:3]))
    after = SearchIndex(spark, index.path).upsert(catalog(spark, ITEMS[2:3]))
    want = S.vocabulary(S.postings(catalog(spark, ITEMS[:3])))
    assert {tuple(r) for r in after.vocabulary().collect()} == {tuple(r) for r in want.select("term", "df", "tf").collect()}


def test_near_terms_of_two_edits_against_brute_force(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 10))) for _ in range(250)}
    wanted = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 10))) for _ in range(80)}
    got = S.near_terms(spark.createDataFrame([(w,) for w in wanted], "word string"), spark.createDataFrame([(w, 1) for w in words], "term string, df int"), 2)
    assert {(r.word, r.term, r.distance) for r in got.collect()} == {(a, b, k) for a in wanted for b in words if (k := osa_distance(a, b)) <= (2 if len(a) >= 7 else 1)}


def test_query_plan(spark, index):
    rows = {r["query"]: r for r in plans(spark, index, "acme mug under 2k", "astronut poster", "AB12345", "the best", "asdfgh", "women mug").collect()}
    acme = rows["acme mug under 2k"]
    assert (acme.words, acme.most, acme.brand, acme.intent) == (["acme", "mug"], 200_000, "Acme", "BRAND")
    assert rows["astronut poster"].corrected + rows["astronut poster"].suggested == ["astronut>astronaut"]
    assert (rows["AB12345"].code, rows["AB12345"].intent, rows["AB12345"].words) == (True, "NAVIGATIONAL", ["ab12345"])
    assert rows["the best"].words == ["the", "best"] and rows["asdfgh"].corrected == [] and rows["women mug"].genders == ["women"]


def test_search_orders_filters_and_policies(spark, index):
    cands, _, _, now = found(spark, index, [("red mug", "")])
    assert listed(P.search(cands, now)) == ["p1", "p2", "p5"]  # exact name, beginning, tags only; p6 can't be found
    by = lambda sig, **how: listed(P.search(found(spark, index, [("red mug", sig)])[0], now, **how))
    assert by("sort:price-desc") == ["p2", "p1", "p5"] and by("price:100000-") == ["p2"] == by("price:900000-100000") == by("availability:on_sale") == by("brand:other")
    assert by("color:blue") == [] and by("rating:4.5") == [] and by("sort:nonsense|junk") == ["p1", "p2", "p5"]
    top = P.search(cands, now).filter("rank = 1").first()
    assert by("", after=(top.total, top.product_id)) == ["p2", "p5"] and P.decode_cursor(P.encode_cursor(top.total, "p:1")) == (top.total, "p:1") and P.decode_cursor("%%") is None
    lamp, _, _, _ = found(spark, index, [("red lamp", "")])
    shown = P.search(lamp, now).first()
    assert shown.product_id == "p4" and shown.penalties == 150.0 and not shown.in_stock
    assert listed(P.search(lamp, now, stock="HIDE")) == [] and listed(P.search(lamp, now, stock="ONLY_IF_EMPTY")) == ["p4"]
    assert listed(P.search(found(spark, index, [("AB12345", "")])[0], now)) == ["p7"]
    with pytest.raises(ValueError):
        P.search(cands, now, weights=P.SEARCH_WEIGHTS | {"popularity": 5.0})


def test_layers_by_hand(spark, index):
    cands, _, _, now = found(spark, index, [("red mug", "")])
    row = {r.product_id: r for r in P.explained(P.search(cands, now)).collect()}
    quality = round(8 * 4 + 2 * 3.33 * 1.0413926851582251 + 5, 3)
    assert row["p1"].text == 400 + 120 and row["p1"].commerce == 1.25 and row["p1"].quality == pytest.approx(quality) and row["p1"].total == pytest.approx(521.25 + row["p1"].entity + quality)
    assert row["p2"].text == 220 + 120 and row["p5"].entity == 2 * 60 and "tag" in row["p5"].matched_on and row["p5"].why.startswith("score ")
    assert P.layer_problems(P.SEARCH_WEIGHTS) == []


def test_facets_leave_their_own_filter_out(spark, index):
    cands, _, _, _ = found(spark, index, [("red mug", "brand:other")])
    got = {(r.axis, r.value): (r.products, r.selected) for r in P.facets(cands).collect()}
    assert got["brand", "acme"] == (2, False) and got["brand", "other"] == (1, True) and got["price", "1"] == (1, False) and ("category", "home/mugs") not in got


def test_recovery(spark, index):
    rows = [("asdfgh", "color:blue"), ("red mug", "")]
    cands, requests, own, now = found(spark, index, rows)
    logs = spark.createDataFrame([("red lamp", 5, DAY)] * 3 + [("asdfgh poster", 2, DAY)], "query string, result_count int, created_at timestamp")
    got = sorted((-r.weight, r.kind, r.offer) for r in P.recover(requests, P.search(cands, now), own, logs, catalog(spark)).collect())
    assert got[0] == (-900, "UNFILTERED", "asdfgh") and (-101, "RELATED", "asdfgh poster") in got and (-50, "POPULAR", "p5") in got


def test_signatures():
    assert P.signature({}) == "" and P.signature({"color": ["red", "blue"], "least": 5, "most": None}) == P.signature({"least": 5, "color": ["blue", "red"]}) == "color:blue,red|price:5-"


def test_outbox(spark):
    box = Outbox(spark)
    rows = [(f"e{k}", "product", f"p{k % 3}", DAY + dt.timedelta(minutes=k)) for k in range(5)] + [("E1 ", "product", "p1", DAY), (None, "product", "p9", DAY)]
    box.emit(spark.createDataFrame(rows, "event_id string, kind string, key string, created_at timestamp"))
    box.emit(spark.createDataFrame(rows[:2], "event_id string, kind string, key string, created_at timestamp"))
    assert box.depth() == {"waiting": 6, "published": 0, "dead": 0}
    first = box.claim(2)
    assert len(first.collect()) == 2
    second = box.claim(10, 1)  # of those not tried yet
    assert second.count() == 4 and not {r.event_id for r in first.collect()} & {r.event_id for r in second.collect()}
    box.acknowledge(second).fail(first, "boom")
    third = box.claim(10)
    box.acknowledge(first)  # a claim that another has taken over by now changes nothing
    assert {(r.event_id, r.attempts) for r in third.collect()} == {(r.event_id, 2) for r in first.collect()} and box.depth()["published"] == 4
    assert box.depth(2)["dead"] == 2 and box.prune(DAY + dt.timedelta(days=1)).depth()["published"] == 0


def test_index_queue(spark):
    index, box = SearchIndex(spark).upsert(catalog(spark, ITEMS[:3])), Outbox(spark)
    box.emit(spark.createDataFrame([("a", "product", "p1", DAY), ("b", "product", "p1", DAY), ("c", "product", "p2", DAY)], "event_id string, kind string, key string, created_at timestamp"))
    assert work_index_queue(box, index, catalog(spark, [product("p1", "Violet Mug")])) == 3
    assert {r.product_id for r in index.rows.read().collect()} == {"p1", "p3"} and index.vocabulary().filter("term = 'violet'").count() == 1
    assert work_index_queue(box, index, catalog(spark)) == 0 and box.depth()["published"] == 3


FEED = 'name,sku\r\n"a ""b""\nc",1\n\nplain "q" x,2\n"closed"tail,3\none\n"open,4'


def test_exact_feed(spark, tmp_path):
    assert list(feed_rows(FEED)) == [(1, ["name", "sku"], None), (2, ['a "b"\nc', "1"], None), (5, ['plain "q" x', "2"], None), (6, ["closedtail", "3"], None), (7, ["one"], None), (8, ["open,4"], "UNCLOSED_QUOTE")]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.csv").write_bytes(b"\xef\xbb\xbf" + FEED.encode())
    (tmp_path / "feed" / "empty.csv").write_bytes(b"")
    got = read_feed_exact(spark, str(tmp_path / "feed"))
    assert [(r.line, r.issue) for r in sorted(got.collect())] == [(2, None), (5, None), (6, None), (7, "FIELD_COUNT_MISMATCH"), (8, "UNCLOSED_QUOTE")]
    assert next(feed_rows("x" * 300_000))[2] == "ROW_TOO_LARGE"
    with pytest.raises(Exception, match="too large"):
        read_feed_exact(spark, str(tmp_path / "feed"), max_bytes=10).collect()


def test_synonym_lines(spark):
    lines = spark.createDataFrame([(1, "tv, television"), (2, "tee -> t-shirt # short"), (3, ""), (4, "# note"), (5, "alone"), (6, "a = A")], "line int, text string")
    assert {tuple(r) for r in read_synonyms(lines).collect()} == {(1, "tv", "television", True, None), (2, "tee", "t-shirt", False, None), (5, "alone", None, True, "two terms are needed"), (6, "a", "a", True, "a term can't stand for itself")}


def test_row_store(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    s = RowStore(spark, scratch(spark, "rows"), "k string, v int", ["k"], 3).apply(rows(("a", 1), ("b", 2), (None, 9)))
    s.apply(rows(("b", 3), ("c", 4)), keys("a", "zzz"), "x", 0).apply(rows(("b", 100)), None, "x", 0)
    assert {tuple(r) for r in RowStore(spark, s.path, "k string, v int", ["k"]).read().collect()} == {("b", 3), ("c", 4)}
    assert s.apply(deletes=keys("b", "c")).read().count() == 0 and s.apply(rows(("q", 1))).read().count() == 1


def test_ledger_by_hand(spark):
    moves = [(1, "STOCK_IN", 10, "a"), (2, "STOCK_IN", 10, "a"), (3, "RESERVED", 4, None), (4, "SALE", 7, None), (5, "SALE", 6, None), (6, "RELEASED", 5, None), (7, "RELEASED", 4, None), (8, "SALE", 4, "s"), (9, "SALE", 1, None), (10, "JUNK", 1, None), (11, "SALE", 0, None), (12, "SALE", None, None)]
    df = spark.createDataFrame([("k", *m) for m in moves] + [("other", 1, "SALE", 1, None)], "k string, t int, op string, quantity bigint, reference string")
    got = {r.t: (r.outcome, r.stock, r.reserved) for r in Z.ledger(df, ["k"], ["t"]).filter("k = 'k'").collect()}
    assert got == {1: ("APPLIED", 10, 0), 2: ("REPEATED", 10, 0), 3: ("APPLIED", 10, 4), 4: ("SHORT", 10, 4), 5: ("APPLIED", 4, 4), 6: ("SHORT", 4, 4), 7: ("APPLIED", 4, 0), 8: ("APPLIED", 0, 0), 9: ("SHORT", 0, 0), 10: ("INVALID", 0, 0), 11: ("INVALID", 0, 0), 12: ("INVALID", 0, 0)}
    assert Z.ledger(df.limit(0), ["k"], ["t"]).count() == 0
    entries = spark.createDataFrame([("k", 1, 0, 5, 5), ("k", 2, 5, -2, 3), ("k", 3, 4, 1, 5), ("k", 4, 5, -9, -4)], "k string, t int, before int, change int, after int")
    assert {r.t for r in Z.broken_entries(entries, ["k"], ["t"]).collect()} == {3, 4}


def test_placed_and_floored_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, float(rng.randint(-3, 3))) for k in range(9000)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    got = {(r.g, r.t): r["rank"] for r in Z.placed(df, ["g"], [F.desc("v"), F.asc("t")], 7).collect()}
    for g in "ab":
        for k, (_, t) in enumerate(sorted((-v, t) for h, t, v in rows if h == g), 1):
            assert got[g, t] == k
    want = {}
    for g, _, v in rows:
        want[g] = max(0.0, want.get(g, 0.0) + v)
    assert {r.g: r.total for r in Z.floored_sums(df, ["g"], ["t"], "v").collect()} == want


def test_exploration_moves_the_back_half_only(spark):
    lists = spark.createDataFrame([("UPSELL", q, f"p{k}", k) for q in ("a", "b") for k in range(1, 13)], "kind string, request string, product_id string, rank int")
    again = lambda seed: {(r.request, r.product_id): r["rank"] for r in N.explore(lists, 0.5, seed).collect()}
    one = again(1)
    assert one == again(1) != again(2) and all(one[q, f"p{k}"] == k for q in "ab" for k in range(1, 7))
    assert all(sorted(v for (x, _), v in one.items() if x == q) == list(range(1, 13)) for q in "ab")
    assert {r["rank"] for r in N.explore(lists, 0.0).collect()} == set(range(1, 13))


def test_slots():
    assert N.slot_type(" also-bought ") == N.slot_type("customer_also_bought") == "CUSTOMER_ALSO_BOUGHT" and N.slot_type("?") is None
    assert all(not N.balance_problems(N.weights_for(k)) for k in N.TYPE_WEIGHTS) and N.balance_problems(N.WEIGHTS | {"popularity": 500.0})
    assert set(N.TYPE_WEIGHTS) == set(N.BUDGETS) and N.seller_ceiling(8) == 3 and N.seller_ceiling(1) == 1
    assert N.policy_for("CONTINUE_SHOPPING") == {"in_stock": True, "cart": True, "purchased": True, "shown": False, "self": True, "duplicates": True}


def test_exclusions_in_order(spark):
    cols = "kind string, request string, product_id string, category_path string, brand_name string, name string, slug string, price_paise bigint, rating_average double, in_stock boolean, score double"
    row = lambda key, name="Mug", stock=True, score=1.0, path="c", slug="s", price=10: ("UPSELL", "seed", key, path, "b", name, slug, price, 4.0, stock, score)
    rows = [row("seed"), row("cart", "a"), row("out", "b", False), row("best", "Shirt M", score=9.0), row("same", "shirt XL", score=8.0), row("no", "c"), row("bad", "d", path="x"), row("dear", "e", price=99), row("blank", "")]
    side = lambda *k: spark.createDataFrame([("seed", x) for x in k], "request string, product_id string")
    got = N.exclude(spark.createDataFrame(rows, cols), side("cart"), side("best"), side(), side("no"), ["x"], 50)
    assert {r.product_id: r.reason for r in got.collect()} == {"seed": "SELF_REFERENCE", "cart": "ALREADY_IN_CART", "out": "OUT_OF_STOCK", "best": None, "same": "DUPLICATE_VARIANT", "no": "NOT_INTERESTED", "bad": "RESTRICTED_CATEGORY", "dear": "PRICE_OUT_OF_RANGE", "blank": "NOT_PURCHASABLE"}


def test_configurations(spark):
    configs = X.ConfigStore(spark)
    configs.save("UPSELL", "1", N.WEIGHTS, N.balance_problems, True).save("UPSELL", "2", N.WEIGHTS | {"quality": 1.0}, N.balance_problems, True)
    assert configs.active("UPSELL", N.WEIGHTS)["quality"] == 1.0 and configs.activate("UPSELL", "1").active("UPSELL", {}) == {} and configs.active("UPSELL", N.WEIGHTS) == N.WEIGHTS
    assert configs.versions("UPSELL").filter("active").count() == 1 and configs.active("CROSS_SELL", N.WEIGHTS) == N.WEIGHTS
    with pytest.raises(ValueError):
        configs.save("UPSELL", "3", N.WEIGHTS | {"quality": 999.0}, N.balance_problems)
    with pytest.raises(KeyError):
        configs.activate("UPSELL", "9")
    assert X.parse_variants('[{"variant": "a", "weight": 2}, {"variant": "", "weight": 1}, {"variant": "b", "weight": 0}, 3]') == [("a", 2.0)] and X.parse_variants("no") == []


def test_pages_and_places():
    assert L.page_meta(9, 24, 50) == {"page": 3, "size": 24, "total": 50, "pages": 3, "has_previous": True, "has_next": False} and L.page_meta(1, 24, 0)["pages"] == 1
    assert L.page_window(5, 10) == [1, None, 4, 5, 6, None, 10] and L.page_window(2, 3) == [1, 2, 3] and L.page_window(4, 6) == [1, 2, 3, 4, 5, 6]
    assert L.between(10, 20) == 15 and L.between(None, 10) == 0 and L.between(10, None) == 20 and L.between(None, None) == 0


def test_moves(spark):
    tree = spark.createDataFrame([("a", "a"), ("b", "a/b"), ("c", "a/b/c"), ("bx", "a/bx"), ("z", "z")], "slug string, path string")
    assert {tuple(r) for r in L.moved(tree, "b", "z").collect()} == {("b", "a/b", "z/b", 1), ("c", "a/b/c", "z/b/c", 2)}
    assert {r.new_path for r in L.moved(tree, "b", None).collect()} == {"b", "b/c"}
    for wrong in ("a/b", "a/b/c"):
        with pytest.raises(ValueError):
            L.moved(tree, "b", wrong)


def test_hashes_and_lines(spark):
    import hashlib
    import hmac

    row = spark.createDataFrame([("naïve 😀", "a: 1\nno\n: x\nb:2:3")], "t string, l string").select(T.fnv1a(F.col("t")).alias("f"), T.hmac_sha256(F.col("t"), "k" * 80).alias("h"), T.labelled_lines(F.col("l")).alias("l")).first()
    want = 2166136261
    units = "naïve 😀".encode("utf-16-le")
    for k in range(0, len(units), 2):
        want = ((want ^ int.from_bytes(units[k : k + 2], "little")) * 16777619) % 2**32
    assert row.f == want and row.h == hmac.new(b"k" * 80, "naïve 😀".encode(), hashlib.sha256).hexdigest()
    assert [tuple(x) for x in row.l] == [("a", "1"), ("b", "2:3")]
    half = spark.range(-7, 8).select("id", C.half_up(F.col("id"), F.lit(2).cast("bigint")).alias("h")).collect()
    assert all(r.h == (abs(r.id) + 1) // 2 * (1 if r.id >= 0 else -1) for r in half)
    assert list(itertools.islice(feed_rows(""), 1)) == []


def test_parameters_come_back():
    from stallwright.operators import params

    state = params.read("?brand=Acme,other&color=Red&min=900&max=12.50&attr.storage=64gb&rating=4.5&sort=newest&page=3&limit=9999&junk=1&rating=x&min=-1")
    assert state == {"filters": {"brand": ["acme", "other"], "color": ["red"], "storage": ["64gb"], "rating": "4.5", "least": 1250, "most": 90_000}, "sort": "newest", "page": 3, "limit": 100, "unknown": ["junk"]}
    assert params.read(params.write(state)) == state | {"unknown": []}
    assert params.read("sort=odd&page=x&availability=maybe&color=") == {"filters": {}, "sort": "relevance", "page": 1, "limit": 24, "unknown": []} and params.write(params.read("")) == ""
    assert params.active(state) == 7 and {c["axis"] for c in params.chips(state)} == set(state["filters"])
    assert "other" in params.chips(state)[0]["without"] and "acme" not in params.chips(state)[0]["without"]
    assert params.merged({"least": 5}, {"least": 1, "most": 9, "brand": ["x"]}) == {"least": 5, "brand": ["x"]}
    assert params.price("1,234.5") == 123_450 and params.price("1.234") is None


def test_sink_adds_a_batch_once(spark, tmp_path):
    from stallwright.sources import schemas

    sink = schemas.Sink(spark, str(tmp_path / "events"), "search_events")
    rows = spark.createDataFrame([("a", "CLICK", DAY, "clash"), ("b", None, DAY, ""), ("c", "CLICK", None, "")], "id string, event_type string, created_at timestamp, batch string")
    assert sink.append(schemas.recordable(rows), "b1") and not sink.append(rows, "b1") and sink.append(rows.limit(1), "b2")
    assert sorted((r.id, r.batch) for r in sink.read().collect()) == [("a", "b1"), ("a", "b2")]
    assert schemas.problems(sink.read(), "search_events") == [] and "position is missing" in schemas.problems(rows, "search_events")
    lists = spark.createDataFrame([(" L1", "UPSELL", "p", 1, DAY), ("l2", "UPSELL", "p", 0, DAY), ("l3", "UPSELL", "q", 2, DAY)], "list_id string, kind string, product_id string, position int, at timestamp")
    got = schemas.impressions(lists, spark.createDataFrame([("l1", "r1"), (None, "r0")], "list_id string, request_id string"))
    assert {(r.product_id, r.recommendation_request_id) for r in got.collect()} == {("p", "r1"), ("q", None)}


def test_variant_grid(spark):
    axes = spark.createDataFrame([("p", "size", 1, "m"), ("p", "color", 0, "red"), ("p", "color", 0, "blue"), ("p", "color", 0, "red"), ("q", "size", 0, "s")], "product_id string, axis string, place int, value string")
    assert {(r.product_id, r.combo, tuple(r["values"])) for r in L.variant_grid(axes).collect()} == {("p", "color:red|size:m", ("red", "m")), ("p", "color:blue|size:m", ("blue", "m")), ("q", "size:s", ("s",))}
    with pytest.raises(Exception, match="too many variants"):
        L.variant_grid(axes, 1).collect()
