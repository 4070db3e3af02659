"""How trace digests are dealt."""

import hashlib
import re

from spanledger.operators import digests


def test_digests_are_dealt_as_bytes_and_seldom(spark):
    rows = [("hot", hashlib.sha256(str(n).encode()).hexdigest()) for n in range(600)] + [(f"k{n}", hashlib.sha256(b"x").hexdigest()) for n in range(5)]
    rows += [("none", None)] + rows[:3]
    found = digests.tree_digest(spark.createDataFrame(rows, "k string, d string"), ["k"], "d")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Copies are counted, the inner levels share a deal, the last has its own.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
    items = {r.k: (r["items"], r.digest) for r in found.collect()}
    assert {k: n for k, (n, _) in items.items()} == {"hot": 603, **{f"k{n}": 1 for n in range(5)}, "none": 1}
    h = lambda text: hashlib.sha256(text.encode()).hexdigest()
    one = rows[600][1]
    assert items["k0"][1] == items["k4"][1] == h(f"{one[:2]}:{h(f'{one[:4]}:{h(one + ":1")}')}")
