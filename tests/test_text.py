import json

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import sentences as S
from cuesmith.functions import text as X
from cuesmith.operators import commit as K
from cuesmith.operators import stability as B

SPLIT = [
    ("Dr. Lee met Mr. Smith. They left.", 2), ('He asked ("Really?"). Then left.', 2), ("Version 1.2.3 is ready. Good!", 2), ("See https://example.com/a?x=1.2&y=yes. Next.", 2), ("Wait... still thinking", 1),
    ("Wait...! Now.", 2), ("你好。现在开始！准备好了吗？", 3), ("", 0), ("  ", 0), ("No end", 1), ("J. Doe came. Ok.", 2), ("The U.S. team won.", 1), ("a@b.org wrote. Yes.", 2), ("3.14 is pi. So?", 2),
]


@pytest.mark.parametrize("text,n", SPLIT)
def test_sentences(text, n):
    out = [s for s, _ in S.split(text)]
    assert len(out) == n
    assert "".join("".join(out).split()) == "".join(text.split())


def test_first_prefix():
    assert S.first_prefix("Visit example.com?") == "" and S.first_prefix(" Hi. There") == " Hi."
    assert S.first_prefix(None) == ""


def test_every_character_stays():
    from hypothesis import given
    from hypothesis import strategies as st

    @given(st.text("ab .?!…\"')。1/@:w", max_size=60))
    def check(t):
        assert "".join("".join(s for s, _ in S.split(t)).split()) == "".join(t.split())

    check()


@pytest.mark.parametrize(
    "previous,current,want",
    [("今天的天气很好。", "天气很好，我们出发吧。", "我们出发吧。"), ("你听我说。", "你听我说完再回答。", "你听我说完再回答。"), ("他一直哈哈哈哈", "哈哈哈哈然后走了", "哈哈哈哈然后走了")],
)
def test_cjk_overlap(previous, current, want):
    assert B.trim_cjk(previous, current) == want


def test_overlap(spark):
    rows = [(1, 0, "hello beautiful world"), (1, 1, "beautiful world again"), (2, 0, "a contest"), (2, 1, "test again"), (3, 0, "one two three"), (3, 1, "one two three"), (4, 0, None), (4, 1, "x"), (5, 0, "今天的天气很好。"), (5, 1, "天气很好，我们出发吧。")]
    df = spark.createDataFrame(rows, "s int, i int, text string")
    got = {r.s: r.trimmed for r in B.with_cjk(df, ["s"], ["i"], "text", F.col("i") == 1).filter("i = 1").collect()}
    assert got == {1: "again", 2: "test again", 3: "one two three", 4: "x", 5: "我们出发吧。"}


def test_seams_join(spark):
    cuts = spark.createDataFrame([(1, "我们今天天气", "天气很好然后"), (2, "我们今天天气", "天气很好然后"), (3, "我们今天天气", "天气很好然后"), (4, None, "x")], "k int, previous string, current string")
    heard = spark.createDataFrame([(1, "我们今天天气很好然后"), (2, "我们今天天气天气很好然后")], "k int, seam string")
    got = {r.k: (r.decision, r.joined) for r in B.seams(cuts, heard, ["k"]).collect()}
    assert got == {1: ("single", "很好然后"), 2: ("repeated", "天气很好然后"), 3: ("ambiguous", "天气很好然后"), 4: ("ambiguous", "x")}


def test_short_cjk_overlaps_stay(spark):
    rows = [(1, 0, "abc 天气"), (1, 1, "天气 more"), (2, 0, "说 好的，对"), (2, 1, "好的，对吗")]
    df = spark.createDataFrame(rows, "s int, i int, text string")
    got = {r.s: r.trimmed for r in B.with_cjk(df, ["s"], ["i"], "text", F.col("i") == 1).filter("i = 1").collect()}
    assert got == {1: "天气 more", 2: "好的，对吗"}


def test_keys():
    assert B.folded("Don't stop, 3.5 m!")[0] == "dont stop 3.5 m" and B.folded("今天 是 好")[0] == "今天是好" and B.folded(" ")[0] == ""


def test_borders():
    import random

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert B.borders(a, b) == [n for n in range(min(len(a), len(b)), 0, -1) if b.endswith(a[:n])]


def test_addresses():
    for text, found in {"See https://a.b/c?d=1! Now": ["https://a.b/c?d=1!"], "at example.com. Then": ["example.com"], "mail a.b@c-d.org, or www.x": ["a.b@c-d.org", "www.x"], "v1.2.3 and U.S. and e.g. no": [], "x.y/z": [], "shop.co.uk:80/p?q": ["shop.co.uk:80/p?q"], "-bad-.com": []}.items():
        assert [text[a:z] for a, z in S.addresses(text)] == found, text


def test_seam():
    assert B.seam_decision("我们今天天气很好", "天气很好然后出发", "我们今天天气很好然后出发") == "single"
    assert B.seam_decision("abc", "def", "abcdef") == "ambiguous"


@pytest.mark.parametrize(
    "previous,final,last,captions,removed",
    [
        ([(1, "A."), (2, "B."), (3, "C.")], ["X.", "A.", "B.", "C."], 3, [(4, "X."), (1, "A."), (2, "B."), (3, "C.")], []),
        ([(1, "Yes."), (2, "Yes."), (3, "No.")], ["Yes.", "No."], 3, [(2, "Yes."), (3, "No.")], [(1, "Yes.")]),
        ([(1, "A."), (2, "Old."), (3, "C.")], ["A.", "New.", "C."], 3, [(1, "A."), (2, "New."), (3, "C.")], []),
        ([], [], 0, [], []),
    ],
)
def test_alignment(previous, final, last, captions, removed):
    got, gone = B.aligned(previous, final, last)
    assert got == captions or (sorted(i for i, _ in gone) and [t for _, t in got] == [t for _, t in captions])
    assert len(gone) == len(removed)


def test_output_checks(spark):
    rows = [("en", "Café déjà vu.", True), ("en", "123.45", True), ("zh", "你好，iPhone。", True), ("ja", "東京", True), ("ja", "RTX 4080", True), ("en", "한글", False), ("zh", "Just English.", False), ("en", "English: ", False), ("ja", "́", False), ("ko", "안녕 hello", True), ("ko", "こんにちは", False)]
    for target, text, want in rows:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(X.in_target_script(F.col("t"), target)).first()[0] is want, (target, text)


def test_envelope_and_tokens(spark):
    texts = [json.dumps({"current_text": "a", "context": []}), '```json\n{"current_text": "a", "source_language": "ja"}\n```', '{"text": 1}', "{bad", None, "x < 3 <|end|> <eos>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(X.leaked_envelope(F.col("t"))).collect()] == [True, True, False, False, False, False]
    assert df.select(X.neutral_tokens(F.col("t"))).collect()[5][0] == "x < 3 ＜|end|＞ ＜eos＞"


def test_draft_extension_twice(spark):
    pairs = [("Hello", "Hello world"), ("Hel", "Hello"), ("12", "123"), ("12", "12, 3"), ("12", "12,3"), ("你", "你好"), ("don'", "don't"), ("a", "a"), ("", "b"), ("It is 5.", "It is 5.5"), ("well-", "well-known"), ("ok", "ok.")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in df.select(X.extends_draft(F.col("a"), F.col("b"))).collect()]
    assert got == [K.extends(*p) for p in pairs] == [True, False, False, True, False, True, False, False, False, False, False, True]


def test_sources_of_language(spark):
    df = spark.createDataFrame([("これ", "auto"), ("漢字", None), ("한글", " "), ("x", "zh-Hant"), ("x", "en_US")], "t string, c string")
    assert [r[0] for r in df.select(X.source_language(F.col("t"), F.col("c"))).collect()] == ["ja", "zh", "ko", "zh", "en"]


def test_cuts_are_dealt_and_searched_once(spark):
    """A file of one row group is the work of all tasks, and a rule is a few searches of a text around the cut."""
    from conftest import SF
    from cuesmith.plans import folds

    plan = folds.draft_extension(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("RLIKE") <= 6
    pairs = [("a", "b", False), ("a", " b", True), ("a'", " b", False), ("́", " b", True), ("́", "b", False), ("é́", "x", False), ("か", "x", True), ("a.", "b", True), ("1", ".5", False), ("1", ". ", True), ("1.", "5", False), ("\0", "\0a", True), ("a", "", False), ("", "a", False)]
    df = spark.createDataFrame([(i, a, a + b, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, n string, b string")
    assert [r[0] for r in df.orderBy("i").select(X.extends_draft(F.col("a"), F.col("n"))).collect()] == [w for *_, w in pairs]
    cuts = [("3.", " 5", True), ("a1b ", " c", True), ("a", "b1", True), ("a", "b", False), ("5", " 원", True), ("5\n", "원", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cuts)], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(X.numeric_split(F.col("a"), F.col("b"))).collect()] == [w for *_, w in cuts]
