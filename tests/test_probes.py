"""Probes of questions, and projections under shared budgets against a plain version."""

import random

from tidemark.plans import probes as P


def test_probes_by_kind(spark):
    text = "Does UCC 9-203 apply to Alice Baker, 15 U.S.C. 2301 or alice baker under Section 402A?"
    q = spark.createDataFrame([(1, text), (2, "plain words"), (3, "# Care of it\nok"), (4, None)], "query_id long, text string")
    got = {}
    for x in P.probes(q).collect():
        got.setdefault((x["query_id"], x["kind"]), []).append(x["probe"])
    assert set(got[1, "citation"]) == {text, "UCC 9-203", "15 U.S.C. 2301", "§ 9-203"} and got[1, "citation"] == got[1, "section"]
    assert got[1, "claim"][0] == text and "Alice Baker" in got[1, "claim"] and "alice baker" not in got[1, "entity"] and len(got[1, "entity"]) <= P.SEMANTIC
    assert got[2, "citation"] == ["plain words"] == got[2, "entity"] and "Care of it" in got[3, "claim"]


def test_hits_take_the_heaviest_kind_and_are_bounded_by_probe(spark):
    items = [(1, "citation", "UCC 9-203"), (1, "entity", "Ada Lane"), (2, "section", "On UCC 9-203 and more"), (3, "claim", "All of Ada Lane must go"), (4, "citation", "UCC 9-2031")] + [(i, "entity", "Ada Lane") for i in range(10, 40)]
    asked = [(7, "citation", "ucc 9-203"), (7, "section", "UCC 9-203"), (7, "claim", "Ada Lane"), (7, "entity", "Ada Lane"), (8, "entity", "??"), (9, "entity", "Nobody Here")]
    got = P.probe_hits(spark.createDataFrame(asked, "query_id long, kind string, probe string"), spark.createDataFrame(items, "id long, kind string, value string"))
    rows = {x["id"]: (x["weight"], x["kinds"]) for x in got.collect()}
    assert rows == {1: (5, "citation,entity"), 2: (3, "section"), 3: (4, "claim")} | {i: (2, "entity") for i in range(10, 19)}


def plain(items, profile, budget):
    """By sorting lists."""
    out = []
    limits, whole = P.LIMITS[profile], sum(P.LIMITS[profile].values())
    for grp in sorted({x[0] for x in items}):
        lists = {}
        for kind in P._ORDER:
            own = {}
            for _, _, v, at in sorted((x for x in items if x[:2] == (grp, kind) and len(x[2]) >= 3), key=lambda x: (x[3], x[2])):
                own.setdefault(v.lower(), (at, v))
            rows = [(at, v) for at, v in own.values()]
            key = {
                "entity": lambda v: (2 * any(m in v.lower() for m in P.WEIGHTY_NAMES) + (any(c.isupper() for c in v) and len(v.split()) > 1), len(v.split()), v.lower()),
                "claim": lambda v: (sum(m in v.lower() for m in P.WEIGHTY_CLAIMS), len(v), v.lower()),
            }.get(kind)
            rows = sorted(rows, key=lambda r: key(r[1]), reverse=True) if key else sorted(rows, key=lambda r: (r[0], r[1].lower()))

            def keeps(v, kind=kind):
                if (profile, kind) not in P.MARKERS:
                    return True
                rule = any(m in f" {v.lower()} " for m in P.MARKERS[profile, kind]) or ((profile, kind) in P._TITLED and any(c.isupper() for c in v) and len(v.split()) >= 2)
                return rule and (profile == "legal" or kind == "section" or not v.lower().startswith(f"generic {kind}"))

            kept = [r for r in rows if keeps(r[1])]
            if len(kept) < min(P.FLOORS.get(profile, {}).get(kind, 0), limits[kind]):
                kept = rows if kind == "section" else kept + [r for r in rows if r not in kept]
            lists[kind] = [v for _, v in kept[: limits[kind]]]
        order = [(max(i + 1 - budget * limits[k] // whole, 0), P._ORDER[k], i + 1, k, v) for k, vs in lists.items() for i, v in enumerate(vs)]
        out += [(profile, budget, grp, k, i, v) for _, _, i, k, v in sorted(order)[:budget]]
    return out


def test_projections_share_a_budget(spark):
    r = random.Random(5)
    words = ["Trust", "must", "api", "step", "Overview", "generic", "claim", "entity", "tool", "Alpha", "beta", "uses", "Court"]
    items = [(r.choice(["a", "b"]), r.choice(["citation", "section", "entity", "entity", "claim"]), " ".join(r.choice(words) for _ in range(r.randrange(1, 4))), i) for i in range(400)]
    items += [("only", "section", "Odd", 1), ("only", "section", "odd", 0), ("only", "entity", "ab", 0)]
    got = P.projected(spark.createDataFrame(items, "grp string, kind string, value string, at long"), budgets=(3, 50)).collect()
    assert sorted(map(tuple, got)) == sorted(x for p in P.LIMITS for b in (3, 50) for x in plain(items, p, b))
