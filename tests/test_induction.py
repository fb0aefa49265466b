"""Induction: pinned hand-derived cases, brute force over all NX subsets, invariances."""

import random

import pytest
from pyspark.sql import functions as F

from bruteforce import induce_owner
from paths import SF0001
from pagesig.operators import induce


def _occ_rows(owner, pages: dict):
    return [(owner, p, e) for p, elems in pages.items() for e in elems]


def _run(spark, cases: dict, aa=3, bb=3):
    rows = [r for owner, pages in cases.items() for r in _occ_rows(owner, pages)]
    df = spark.createDataFrame(rows, "owner string, page long, element string")
    out = induce.sg_induce(df, aa, bb).collect()
    res = {}
    for r in out:
        res.setdefault(r.owner, set()).add((tuple(r.signature), tuple(r.pages)))
    return res


def _u(p):
    return f"U{p}"


def _pages(spec: dict, n=7, no_unique=()):
    """spec: {page: [elements]}; every page also gets its unique element unless excluded."""
    out = {}
    for p in range(n):
        out[p] = list(spec.get(p, [])) + ([] if p in no_unique else [_u(p)])
    return out


PINNED = {
    "kept": (_pages({p: ["A", "B", "B"] for p in range(4)}),
             {(("A", "B", "B"), (0, 1, 2, 3))}),
    "eliminated_by_empty_set": (_pages({p: ["A"] for p in range(5)}),
                                {(("A",), (0, 1, 2, 3, 4))}),
    "eliminated_by_nx": (_pages({**{p: ["A"] for p in range(7)},
                                 **{p: ["A", "X"] for p in (0, 1, 2)},
                                 **{p: ["A", "Y"] for p in (3, 4, 5)}}),
                         set()),
    "rescued_by_only_nx": (_pages({**{p: ["A"] for p in range(7)},
                                   **{p: ["A", "X"] for p in (0, 1, 2)},
                                   **{p: ["A", "Y"] for p in (3, 4, 5)}}, no_unique=(6,)),
                           {(("A",), (0, 1, 2, 3, 4, 5, 6))}),
    "too_many_groups": (_pages({0: ["A"], 1: ["A"], 2: ["A", "B"], 3: ["A", "B"], 4: ["B"], 5: ["B"]}),
                        set()),
    "multiplicity_splits": (_pages({0: ["A"], 1: ["A"], 2: ["A", "A"], 3: ["A", "A"]}),
                            {(("A",), (0, 1)), (("A", "A"), (2, 3))}),
    "q1_last_state": (_pages({0: ["A", "X"], 1: ["A", "X", "X"], 2: ["A", "A"], 3: ["A", "A"]}),
                      {(("A",), (0, 1)), (("A", "A"), (2, 3))}),
}


@pytest.mark.parametrize("name", sorted(PINNED))
def test_pinned_cases(spark, name):
    pages, expected = PINNED[name]
    got = _run(spark, {name: pages}).get(name, set())
    assert got == expected
    assert {(tuple(s), tuple(m)) for s, m in induce_owner(pages)} == expected


def test_search_step_example(spark):
    """10 pages, DX blocks {0}, {1..4}, {5..9}; one line twice on pages 2 and 8;
    onlyNX = 1,4,5,6,8,9: block {0} is eliminated by S = {} (1+3-1 = 3), the others survive."""
    only_nx = {1, 4, 5, 6, 8, 9}
    pages = {}
    for p in range(10):
        e = []
        if 1 <= p <= 4:
            e.append("D1")
        if 5 <= p <= 9:
            e.append("D2")
        if p in (2, 8):
            e += ["L", "L"]
        if p not in only_nx:
            e.append(_u(p))
        pages[p] = e
    got = _run(spark, {"s": pages})["s"]
    assert got == {(("D1",), (1, 2, 3, 4)), (("D2",), (5, 6, 7, 8, 9))}


def _random_owner(rng: random.Random, n_pages=7):
    alphabet = [f"e{i}" for i in range(rng.randint(2, 7))]
    pages = {}
    for p in range(n_pages):
        elems = []
        for e in alphabet:
            if rng.random() < 0.45:
                elems += [e] * rng.choice([1, 1, 1, 2, 3])
        if rng.random() < 0.6:
            elems.append(f"u{p}")
        if not elems:
            elems.append(f"u{p}")
        pages[p] = elems
    return pages


def test_matches_brute_force_on_random_owners(spark):
    rng = random.Random(7)
    cases = {f"o{i}": _random_owner(rng) for i in range(400)}
    got = _run(spark, cases)
    survivors = 0
    for owner, pages in cases.items():
        exp = {(tuple(s), tuple(m)) for s, m in induce_owner(pages)}
        survivors += len(exp)
        assert got.get(owner, set()) == exp, owner
    assert survivors > 50


def test_invariant_under_page_order_and_renaming(spark):
    rng = random.Random(11)
    cases = {f"o{i}": _random_owner(rng) for i in range(60)}
    renamed = {}
    for owner, pages in cases.items():
        renamed[owner] = {100 - p: [f"z_{e}" for e in elems] for p, elems in pages.items()}
    a, b = _run(spark, cases), _run(spark, renamed)
    for owner in cases:
        sa = {(tuple(f"z_{e}" for e in s), tuple(sorted(100 - p for p in m))) for s, m in a.get(owner, set())}
        sb = {(tuple(sorted(s)), m) for s, m in b.get(owner, set())}
        assert sa == sb


def test_orders_corpus_matches_brute_force(spark):
    from pagesig.plans import induction
    occ = induction.orders_occurrences_selected(spark, SF0001).toPandas()
    got = {(r.owner, tuple(r.signature), tuple(r.pages))
           for r in induction.induce_orders(spark, SF0001).collect()}
    exp = set()
    for owner, g in occ.groupby("owner"):
        pages = {p: list(gg.element) for p, gg in g.groupby("page")}
        for s, m in induce_owner(pages):
            exp.add((owner, tuple(s), tuple(m)))
    assert got == exp and len(got) == 18


def test_noise_pairs_by_key(spark):
    pages = _pages({p: ["A", "B", "B"] for p in range(4)})
    df = spark.createDataFrame(_occ_rows("k", pages), "owner string, page long, element string")
    ind = induce.sg_induce(df)
    noise = induce.sg_noise(ind, df).collect()
    # pages 0-3 each hold A, B, B and their unique element: 4 occurrences, 3 explained
    assert [(r.noise) for r in noise] == [4]
    assert noise[0].pages == [0, 1, 2, 3]
    assert F is not None


def test_more_than_63_pages_is_refused(spark):
    rows = [("o", p, "A") for p in range(64)]
    df = spark.createDataFrame(rows, "owner string, page long, element string")
    with pytest.raises(Exception, match="at most 63"):
        induce.sg_induce(df).collect()
    from pagesig.operators.select import wn_last_k_hosts
    with pytest.raises(ValueError):
        wn_last_k_hosts(df, k=64)


def test_last_level_builds_no_states(spark):
    occ = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 2, "y"), (1, 3, "y")], "owner long, page long, element string")
    parts = induce.induction_parts(occ)
    plan = parts["eliminated"]._jdf.queryExecution().analyzed().toString()
    assert plan.count(" AS states#") == parts.aa  # the first ones and those of all levels but the last
