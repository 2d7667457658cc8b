import random
from collections import Counter

import pytest

from scriptorium.operators import schedule


def test_no_minute_holds_more_than_its_budget(spark):
    r = random.Random(2)
    rows = [(k, r.randint(1, 3), r.randint(0, 900)) for k in range(3000)]
    got = schedule.minutes(spark.createDataFrame(rows, "doc_id long, attempt long, tokens long").repartition(7), 900, 5000).collect()
    spent, at = Counter(), 0
    for row in sorted(got, key=lambda x: (x["attempt"], x["doc_id"])):
        assert row["before"] == at and row["minute"] == at // 4100
        at += row["tokens"]
        spent[row["minute"]] += row["tokens"]
    assert len(got) == 3000 and max(spent.values()) <= 5000 and min(spent[m] for m in range(max(spent))) > 3200
    assert schedule.minutes(spark.createDataFrame([], "doc_id long, attempt long, tokens long"), 900).isEmpty()
    with pytest.raises(ValueError):
        schedule.minutes(spark.createDataFrame([], "doc_id long, attempt long, tokens long"), 30_000)
