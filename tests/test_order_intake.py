"""Order intake (I1) against a plain sequential loop over the same carts."""

import random
from decimal import Decimal

import pytest

from marketlens import schema as S
from marketlens.operators import changes


def sequential(carts, products):
    """Reference rule, one cart after the other (unknown product and bad
    quantity are reported before stock, as documented)."""
    stock = {p: s for p, (price, s) in products.items()}
    out = {}
    for cart_id, seq, items in sorted(carts, key=lambda c: c[1]):
        if not items:
            out[cart_id] = (False, "empty_cart", None)
            continue
        bad = None
        for pid, q in items:
            if pid not in products:
                bad = f"unknown_product:{pid}"
                break
            if q is None or q <= 0:
                bad = f"bad_quantity:{pid}"
                break
        if bad is None:
            for pid, q in items:
                if stock[pid] < q:
                    bad = f"out_of_stock:{pid}"
                    break
        if bad is not None:
            out[cart_id] = (False, bad, None)
            continue
        total = sum(products[pid][0] * q for pid, q in items)
        for pid, q in items:
            stock[pid] -= q
        out[cart_id] = (True, None, total)
    return out, stock


def run_spark(spark, carts, products):
    cdf = spark.createDataFrame(
        [(c, s, 1, [(p, q) for p, q in items] if items is not None else None, None, None)
         for c, s, items in carts], S.CART_REQUESTS)
    pdf = spark.createDataFrame([(p, Decimal(pr), st) for p, (pr, st) in products.items()],
                                "id bigint, price decimal(18,2), stock int")
    res = changes.intake_orders(cdf, pdf, bucket_width=4)
    got = {r.cart_id: (r.accepted, r.reason, r.total_amount) for r in res.decisions.collect()}
    stock = {r.id: r.stock for r in res.products.collect()}
    return got, stock, res


@pytest.mark.parametrize("seed_value", [1, 2, 3])
def test_random_carts_match_sequential_loop(spark, seed_value):
    rng = random.Random(seed_value)
    products = {p: (rng.randint(1, 9) * 10, rng.randint(0, 8)) for p in range(1, 6)}
    carts = []
    for c in range(40):
        n = rng.choice([0, 1, 2, 2, 3, 4])
        items = [(rng.choice([1, 2, 3, 4, 5, 5, 9]) if rng.random() > 0.05 else 99, rng.randint(1, 4))
                 for _ in range(n)]
        carts.append((c, rng.randint(0, 10_000) * 40 + c, items))
    want, want_stock = sequential(carts, products)
    got, got_stock, res = run_spark(spark, carts, products)
    for cid, (ok, reason, total) in want.items():
        g = got[cid]
        assert (g[0], g[1]) == (ok, reason), cid
        if ok:
            assert float(g[2]) == float(total)
    assert got_stock == want_stock


def test_duplicate_lines_checked_alone_and_all_deducted(spark):
    products = {1: (10, 3)}
    carts = [(1, 1, [(1, 2), (1, 2)]), (2, 2, [(1, 1)])]
    got, stock, _ = run_spark(spark, carts, products)
    assert got[1][0] is True and stock[1] == -1
    assert got[2] == (False, "out_of_stock:1", None)


def test_rejected_cart_frees_stock_for_later_ones(spark):
    products = {1: (10, 5), 2: (20, 1)}
    carts = [(1, 1, [(2, 1)]), (2, 2, [(1, 4), (2, 1)]), (3, 3, [(1, 5)])]
    got, stock, _ = run_spark(spark, carts, products)
    assert got[1][0] and not got[2][0] and got[3][0]
    assert stock == {1: 0, 2: 0}


def test_replay_of_driver_orders_matches_loop(spark):
    from marketlens.plans.change_queries import _replay_carts
    from marketlens.sources.adapter import DriverShop

    shop = DriverShop(spark, "/root/testdata/sf0.001")
    carts_df = _replay_carts(shop)
    prods = {r.id: (r.price, r.stock) for r in shop.products().select("id", "price", "stock").collect()}
    carts = [(r.cart_id, r.seq, [(i.productId, i.quantity) for i in (r["items"] or [])])
             for r in carts_df.collect()]
    want, want_stock = sequential(carts, prods)
    res = changes.intake_orders(carts_df, shop.products())
    got = {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()}
    assert got == {c: (ok, reason) for c, (ok, reason, _) in want.items()}
    assert {r.id: r.stock for r in res.products.collect()} == want_stock


def test_long_chain_has_no_round_cap(spark):
    n = 70  # each cart waits for the one before it
    products = {p: (10, 1) for p in range(n + 1)}
    carts = [(i, i, [(i, 1), (i + 1, 1)]) for i in range(n)]
    want, want_stock = sequential(carts, products)
    got, got_stock, res = run_spark(spark, carts, products)
    assert {c: g[:2] for c, g in got.items()} == {c: w[:2] for c, w in want.items()}
    assert got_stock == want_stock
    # Rounds carry what is still open, and less of it each time.
    assert res.open_lines == sorted(res.open_lines, reverse=True) and res.open_lines[-1] == 0


def test_cart_of_null_lines_is_empty_and_no_carts_is_fine(spark):
    carts = spark.createDataFrame([(1, 1, 1, [None], None, None)], S.CART_REQUESTS)
    products = spark.createDataFrame([(1, Decimal(1), 3)], "id bigint, price decimal(18,2), stock int")
    res = changes.intake_orders(carts, products)
    assert [(r.accepted, r.reason) for r in res.decisions.collect()] == [(False, "empty_cart")]
    assert res.orders.count() == 0
    none = changes.intake_orders(carts.limit(0), products)
    assert none.decisions.count() == 0


def test_new_rows_fit_their_tables(spark):
    carts = spark.createDataFrame([(7, 1, 4, [(1, 2), (1, 1)], None, None)], S.CART_REQUESTS)
    products = spark.createDataFrame([(1, Decimal(5), 9)], "id bigint, price decimal(18,2), stock int")
    res = changes.intake_orders(carts, products, last_ids={"orders": 6})
    order, lines, events = res.orders.first(), res.items.collect(), res.cart_events.collect()
    assert order.created_at is not None and order.id == 7
    assert len({r.id for r in lines}) == 2
    assert all(e.created_at is not None and e.session_id for e in events)


def test_lines_above_the_whole_stock_never_enter_the_rounds(spark):
    products = {p: (10, 2) for p in range(4)}
    carts = [(i, i, [(i % 4, 3), ((i + 1) % 4, 1)]) for i in range(12)]  # 3 > 2, whoever came before
    want, want_stock = sequential(carts, products)
    got, stock, res = run_spark(spark, carts, products)
    assert {c: g[:2] for c, g in got.items()} == {c: w[:2] for c, w in want.items()}
    assert stock == want_stock and res.open_lines == [0]


def test_seq_is_cut_into_ranges_for_a_hot_product_only(spark, monkeypatch):
    calls = []
    real = changes.seq_bounds
    monkeypatch.setattr(changes, "seq_bounds", lambda *a: calls.append(a[2]) or real(*a))

    def check(products, carts):
        cdf = spark.createDataFrame([(c, s, 1, items, None, None) for c, s, items in carts], S.CART_REQUESTS)
        pdf = spark.createDataFrame([(p, Decimal(pr), st) for p, (pr, st) in products.items()],
                                    "id bigint, price decimal(18,2), stock int")
        want, want_stock = sequential(carts, products)
        res = changes.intake_orders(cdf, pdf, bucket_rows=8)
        assert {r.cart_id: (r.accepted, r.reason) for r in res.decisions.collect()} == {
            c: w[:2] for c, w in want.items()}
        assert {r.id: r.stock for r in res.products.collect()} == want_stock

    check({p: (10, 4) for p in range(8)}, [(i, i, [(i % 8, 2), ((i + 3) % 8, 1)]) for i in range(24)])
    assert not calls  # 48 lines, six a product
    check({1: (10, 30), 2: (10, 5)}, [(i, i, [(1, 1 + i % 3)] + [(2, 1)] * (i % 2)) for i in range(40)])
    assert calls


def test_decisions_of_repeated_carts_and_products(spark):
    carts = spark.createDataFrame(
        [(1, 1, 4, [(1, 1)], None, None)] * 2 + [(2, 2, 4, [(1, 5), (9, 1)], None, None),
                                                  (3, 3, 4, [(1, 2), (2, 3)], None, None),
                                                  (4, 4, 4, [None, (2, 2)], None, None)], S.CART_REQUESTS)
    products = spark.createDataFrame([(1, Decimal(5), 3)] * 2 + [(2, Decimal(7), 2)],
                                     "id bigint, price decimal(18,2), stock int")
    got = sorted((r.cart_id, r.accepted, r.reason, r.total_amount) for r in
                 changes.intake_orders(carts, products).decisions.collect())
    # Two carts of one number, each line at two prices: four lines of one unit.
    assert got == [(1, True, None, Decimal(20)), (1, True, None, Decimal(20)), (2, False, "unknown_product:9", None),
                   (3, False, "out_of_stock:1", None), (4, True, None, Decimal(14))]
