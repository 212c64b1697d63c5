"""A name that was cut short stands for the longest spelling that goes on from it, never for a shorter one."""

import random

from ledgerloom.operators import names


def test_longest_is_the_longest_that_goes_on(spark):
    rng, rows = random.Random(3), [(1, k) for k in ("SUPPLIER123", "SUPPLIER1", "SUPPLIER12|BANK", "SUPPLIER129")] + [(9, None), (9, "")]
    for account in range(2, 7):
        rows += [(account, "ABABAB" + "".join(rng.choice("AB ") for _ in range(rng.randrange(6))) + rng.choice(["", "|BANK", "|LONG BANK"])) for _ in range(80)]
    got = {(r.account_id, r.key): r.canonical for r in names.canonical_keys(spark.createDataFrame(rows, "account_id long, key string"), rule=names.longest).collect()}
    flat = lambda k: k.split("|")[0].replace(" ", "")
    own = lambda account: {k for a, k in rows if a == account and k}
    assert got == {(a, k): min((o for o in own(a) if flat(o).startswith(flat(k))), key=lambda o: (-len(o), o)) for a, k in rows if k}
    assert got[1, "SUPPLIER123"] == "SUPPLIER123" and got[1, "SUPPLIER1"] == "SUPPLIER12|BANK"
