import random
import unicodedata

from pyspark.sql import functions as F

from scriptorium.functions import bidi

PAIRS = dict(zip(*bidi.MIRRORED, strict=True))


def shown(line):
    """The algorithm's implicit part, character by character."""
    kinds = [unicodedata.bidirectional(c) for c in line]
    base = next((int(k != "L") for k in kinds if k in ("L", "R", "AL")), 0)
    sos, now = "LR"[base], list(kinds)
    n = len(now)
    for i in range(n):  # marks
        if now[i] == "NSM":
            now[i] = now[i - 1] if i else sos
    strong = sos
    for i, k in enumerate(now):
        if k in ("L", "R", "AL"):
            strong = k
        elif k == "EN" and strong == "AL":
            now[i] = "AN"
    now = ["R" if k == "AL" else k for k in now]
    for i in range(1, n - 1):
        if now[i] in ("ES", "CS") and now[i - 1] == now[i + 1] == "EN":
            now[i] = "EN"
        elif now[i] == "CS" and now[i - 1] == now[i + 1] == "AN":
            now[i] = "AN"
    i = 0
    while i < n:
        j = i
        while j < n and now[j] == "ET":
            j += 1
        if j > i and ((i and now[i - 1] == "EN") or (j < n and now[j] == "EN")):
            now[i:j] = ["EN"] * (j - i)
        i = max(j, i + 1)
    now = ["ON" if k in ("ES", "ET", "CS") else k for k in now]
    strong = sos
    for i, k in enumerate(now):
        if k in ("L", "R"):
            strong = k
        elif k == "EN" and strong == "L":
            now[i] = "L"
    i = 0
    side = lambda k: "R" if k in ("EN", "AN", "R") else "L"
    while i < n:
        j = i
        while j < n and now[j] not in ("L", "R", "EN", "AN"):
            j += 1
        if j > i:
            left, right = side(now[i - 1]) if i else sos, side(now[j]) if j < n else sos
            now[i:j] = [left if left == right else sos] * (j - i)
        i = max(j, i + 1)
    level = [{"L": (0, 2), "R": (1, 1), "EN": (2, 2), "AN": (2, 2)}[k][base] for k in now]
    i = n - 1
    reset = True
    for i in range(n - 1, -1, -1):
        if kinds[i] == "S":
            reset = True
        elif kinds[i] != "WS":
            reset = False
        if reset:
            level[i] = base
    out = [(PAIRS.get(c, c) if v % 2 else c, v) for c, v in zip(line, level, strict=True)]
    for least in (2, 1):
        i = 0
        while i < n:
            j = i
            while j < n and out[j][1] >= least:
                j += 1
            out[i:j] = reversed(out[i:j])
            i = max(j, i + 1)
    return "".join(c for c, _ in out)


def test_random_lines_agree_with_a_plain_implementation(spark):
    r = random.Random(12)
    pools = ["אבת", "abZé", "0127", " \t", ",.:/+-", "$%#₪", "()[]<>!?\"'", "اب١٤", "ִ́", "中\U0001f600"]
    lines = ["".join(r.choice(r.choice(pools[: r.randint(2, len(pools))])) for _ in range(r.randint(0, 16))) for _ in range(6000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, x string").select("k", bidi.display_order(F.col("x")).alias("y"))
    got = {row["k"]: row["y"] for row in df.collect()}
    bad = [(x, got[k], shown(x)) for k, x in enumerate(lines) if got[k] != shown(x)]
    assert not bad, (len(bad), bad[:3])
    assert sum(got[k] != x for k, x in enumerate(lines)) > 3000


def test_lines_nulls_and_latin(spark):
    hebrew = "שלום"
    rows = [(None, None), ("", ""), ("abc (1)", "abc (1)"), (f"{hebrew} 12.5 (abc)\n\nxy {hebrew}!", f"(abc) 12.5 {hebrew[::-1]}\n\nxy {hebrew[::-1]}!")]
    df = spark.createDataFrame(rows, "x string, want string")
    assert [r["y"] for r in df.select(bidi.display_order(F.col("x")).alias("y")).collect()] == [w for _, w in rows]
