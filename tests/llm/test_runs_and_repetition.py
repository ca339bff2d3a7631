import random
import re

import pytest
from pyspark.sql import functions as F

from subtide.llm import repetition as rep
from subtide.llm import runs

RUN = "series string, episode string, pos int, id bigint, start_ms bigint, end_ms bigint, text string, k0 string, p string"


def near(a, b):
    if not a or not b:
        return False
    if a == b:
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_runs(rows):
    out, keys = [], {r[:2] for r in rows}
    plain = lambda t: re.sub(r"[\W_]", "", t or "").lower()
    for key in keys:
        mine = sorted([r for r in rows if r[:2] == key and r[4] is not None and r[5] is not None and r[5] > r[4]], key=lambda r: (r[2] if r[2] is not None else -(2**62), r[3]))
        run = []
        for r in [*mine, None]:
            if r is not None and run and r[4] <= run[-1][5] + 3000 and near(plain(run[-1][6]), plain(r[6])):
                run.append(r)
                continue
            if len(run) > 1:
                out.append((*key, run[0][3], run[-1][3], len(run), run[0][4], max(x[5] for x in run)))
            run = [r]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "block"), [(0, 1), (1, 4), (2, 4096)])
def test_runs_against_brute_force(spark, seed, block):
    r = random.Random(seed)
    texts = ["走吧！", "走 吧", "我只问你一句残卷在哪里", "我只问你一句，残卷在那里", "我只问你一句，残卷在里", None, "", "……", "Run!", "run"]
    rows, clock = [], 0
    for i in range(500):
        key = ("hot", "1") if r.random() < 0.8 else (r.choice(["a", None]), "2")
        clock += r.choice([200, 900, 5000])
        text = r.choice(texts) if not rows or r.random() < 0.5 else rows[-1][6]
        s, t = clock, clock + r.choice([500, 1500, -10])
        rows.append((*key, None if r.random() < 0.02 else i, i, None if r.random() < 0.02 else s, t, text))
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], RUN)
    got = runs.collapse_runs(df, ["series", "episode"], "pos", "id", "text", singletons=False, block=block)
    assert sorted([(x.series, x.episode, x.first_id, x.last_id, x.n, x.start_ms, x.end_ms) for x in got.collect()], key=repr) == brute_runs(rows)
    every = runs.collapse_runs(df, ["series", "episode"], "pos", "id", "text", block=block)
    assert every.agg(F.sum("n")).first()[0] == sum(1 for x in rows if x[4] is not None and x[5] > x[4])
    assert runs.collapse_runs(df.limit(0), ["series", "episode"], "pos", "id", "text").count() == 0


def without_stutter(t, unit=3):
    """What is said three times or more on end, in units of up to three letters, once; leftmost and shortest unit first."""
    out, i = "", 0
    while i < len(t):
        for u in range(1, unit + 1):
            n = 1
            while t[i + n * u : i + (n + 1) * u] == t[i : i + u] and i + (n + 1) * u <= len(t):
                n += 1
            if n >= 3 and i + u <= len(t):
                out, i = out + t[i : i + u], i + n * u
                break
        else:
            out, i = out + t[i], i + 1
    return out


def brute_share(text):
    """From the statement: letters in second or later copies. A copy is a passage of four letters, or of six of which one
    inside differs, that stood before without overlapping it; and what is said three times or more on end."""
    t = re.sub(r"[\W_]", "", text or "").lower()
    once = without_stutter(t)
    covered = set()
    for j in range(len(once)):
        for i in range(j):
            for n, changes in ((4, 0), (6, 1)):
                a, b = once[i : i + n], once[j : j + n]
                if len(b) == n and i + n <= j and a[0] == b[0] and a[-1] == b[-1] and sum(x != y for x, y in zip(a, b, strict=True)) <= changes:
                    covered |= set(range(j, j + n))
    return (len(t) - len(once) + len(covered)) / len(t) if t else 0.0


CASES = [
    "我们的宗门不会输。" * 6, "我们的宗门不会输！" + "我们的宗门不会芷，" * 5, "不要" * 20, "啊" * 40, "天机不可泄露。" + "衍岚从后山带回了阵旗。别动，有人来了。\n" * 4, "明镜止水心如磐石。" * 5,
    "快跑他们追上来了，刹樾，快跑他们追上来了，曜冥，快跑他们追上来了，琅夜，快跑他们追上来了，", "是不是" * 6 + "你在这里", "然后" * 7 + "他走了", "别动有人来了" * 4, "走吧快走吧，" * 3, "谢谢观看下期再见！谢谢明看下期再见！谢谢观看下期再见，", "那个" * 12 + "雪停之后之。", "那个" * 6,
]
SOUND = [
    "把古剑交出来！你以为骨笛还在我手里吗？我早就说过，墟丹靠不住。把古剑交出来！", "玄冥来了。我听见玄冥在后山。玄冥走了，别找玄冥。", "走吧走吧走吧", "", None, "……", "走吧", "哈哈哈哈，三日之后所有人都要交出令牌。",
    "长老们大会之前就会知道真相。冥鹄，你先喝口水。十名守卫正在赶往驿站。长老们大会之前就会知道真相。", "别动，有人来了，走。别动，有人来了。",
]


def shares(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {x.i: x.m.repeated_share for x in df.select("i", rep.measures(F.col("t")).alias("m")).collect()}


def test_shares_against_brute_force(spark):
    r = random.Random(3)
    texts = CASES + SOUND + ["".join(r.choice("甲乙") for _ in range(n)) for n in (7, 8, 11, 12, 13, 25, 40, 80)] + [("甲乙丙丁戊己庚"[:n] * 30)[:m] for n in range(1, 8) for m in (11, 12, 25, 60)]
    for _ in range(60):
        piece = "".join(r.choice("甲乙丙丁戊己庚辛") for _ in range(r.randrange(2, 25)))
        copy = lambda p: p[: (k := r.randrange(len(p)))] + r.choice("甲乙x") + p[k + 1 :] if r.random() < 0.4 else p
        texts.append("".join(copy(piece) + r.choice(["，", "", "天地玄黄宇宙洪荒"]) for _ in range(r.randrange(1, 8))))
    assert shares(spark, texts) == pytest.approx({i: brute_share(t) for i, t in enumerate(texts)})


def test_flags(spark):
    words = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"
    rows = [(i, t, None) for i, t in enumerate(CASES + SOUND)] + [(99, "走吧", [(0, 1, "我们的宗门不会输"), None, (1, 2, None)] + [(2, 3, "我们的宗门不会输")] * 5)]
    df = spark.createDataFrame([(*x, "m") for x in rows], f"id int, text string, words {words}, m string")
    got = {r.id for r in rep.flagged(df, "id", "text", "words").filter(F.arrays_overlap("flags", F.array(*map(F.lit, rep.REPEATED)))).collect()}
    assert got == {*range(len(CASES)), 99}
    full = {r.id: r.flags for r in rep.repetition(df, "id", "text", "words").collect()}
    assert {i for i, f in full.items() if set(f) & set(rep.REPEATED)} == got
    assert "mostly_symbols" not in full[len(CASES) + 3] and rep.repetition(df.limit(0), "id", "text").count() == 0


def test_long_texts_take_no_longer_than_their_length(spark):
    r = random.Random(1)
    long = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(40_000))
    got = shares(spark, [long, long[:20_000] * 2, "哈" * 60_000, "哈哈走吧" * 5_000])
    assert got[0] < 0.01 and abs(got[1] - 0.5) < 0.01 and got[2] > 0.99 and got[3] > 0.99


@pytest.mark.parametrize("copies", [10, 20, 40])
def test_copies_that_differ_from_each_other_count(spark, copies):
    """Every copy has one other character changed, so only the first is near to all of them."""
    r = random.Random(copies)
    texts = []
    for size in (8, 12, 12, 14, 20):
        letters = [chr(0x4E00 + k) for k in r.sample(range(3000), size + 600)]
        piece, other = "".join(letters[:size]), iter(letters[size:])
        changed = lambda p: p[: (k := r.randrange(len(p)))] + next(other) + p[k + 1 :]
        texts.append(piece + "".join("".join(next(other) for _ in range(3)) + changed(piece) for _ in range(copies - 1)))
    got = shares(spark, texts)
    assert got == pytest.approx({i: brute_share(t) for i, t in enumerate(texts)}) and min(got.values()) > 0.5
