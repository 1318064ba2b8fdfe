"""The change windows against a sequential model, with random changes, empty owners, zero values and a loaded state."""

import random

import pytest

from ledgerloom.operators import changes as C

COLUMNS = "seq bigint, kind string, op string, token_id string, owner_did string, token_value double, token_status int"


def random_changes(rng, n, first=0):
    rows = []
    for seq in range(first, first + n):
        kind = rng.choice(["RBT", "FT", "NFT", "SC"])
        gone = rng.random() < 0.25
        rows.append((seq, kind, "DELETE" if gone else "UPSERT", f"{kind}{rng.randrange(25)}", "" if gone or rng.random() < 0.1 else f"d{rng.randrange(6)}", 0.0 if gone or rng.random() < 0.2 else rng.randrange(1, 5000) / 1000, 0 if gone else rng.choice([0, 0, 1])))
    return rows


def replay(rows, tokens, dids):
    for _, kind, op, token, owner, value, status in rows:
        key, amount = (kind, token), (lambda v: round(v * 1000) if kind == "RBT" else 1)  # noqa: B023
        if op == "DELETE":
            if key in tokens:
                own, had, _ = tokens.pop(key)
                if own in dids:
                    dids[own][kind] = max(0, dids[own][kind] - amount(had))
            continue
        new = key not in tokens
        if new:
            tokens[key] = (owner, value, status)
        else:
            old = tokens[key]
            tokens[key] = (owner or old[0], value or old[1], status or old[2])
        if status == 0 or kind in ("NFT", "SC"):
            if owner not in dids:
                dids[owner] = {"RBT": 0, "FT": 0, "NFT": 0, "SC": 0}
                dids[owner][kind] = amount(value)
            elif new:
                dids[owner][kind] += amount(value)


def as_rows(spark, tokens, dids):
    t = spark.createDataFrame([(k, i, *v) for (k, i), v in tokens.items()], "kind string, token_id string, owner_did string, token_value double, token_status int")
    d = spark.createDataFrame([(did, *(v[k] for k in ("RBT", "FT", "NFT", "SC"))) for did, v in dids.items()], "did string, RBT bigint, FT bigint, NFT bigint, SC bigint")
    return t, d


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    first, second = random_changes(rng, 300), random_changes(rng, 300, 300)
    tokens, dids = {}, {}
    replay(first, tokens, dids)
    old = as_rows(spark, tokens, dids)
    got = C.did_totals(spark.createDataFrame(first, COLUMNS))
    assert {r.did: (r.RBT, r.FT, r.NFT, r.SC) for r in got.collect()} == {k: tuple(v.values()) for k, v in dids.items()}
    replay(second, tokens, dids)
    changes = spark.createDataFrame(second, COLUMNS)
    state = C.token_state(changes, old[0]).collect()
    assert {(r.kind, r.token_id): (r.owner_did, r.token_value, r.token_status) for r in state} == tokens
    got = C.did_totals(changes, *old, span=7).collect()
    assert {r.did: (r.RBT, r.FT, r.NFT, r.SC) for r in got} == {k: tuple(v.values()) for k, v in dids.items()}


def test_no_changes(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert C.did_totals(none).count() == 0 and C.token_state(none).count() == 0


def test_loading_twice_changes_nothing(spark):
    from ledgerloom.operators.assets import insert_if_absent

    old = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2, 0), ("b", 3, 0), ("b", 4, 1)], "id string, v int, arrival int")
    once = insert_if_absent(old, new, "id")
    twice = insert_if_absent(once, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3)]
