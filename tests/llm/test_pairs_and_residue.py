import pytest

from subtide.llm import pairs, residue

GOOD = [
    ("那封信是玉简写的。", "That letter was written by Yujian."), ("我听见后山有笛声。", "I can hear a flute from the back hill."), ("你的修为又退步了。", "Your cultivation has slipped again."), ("师父，弟子知错了。", "Master, your disciple admits the mistake."),
    ("我在山门等了你三年。", "I waited for you at the mountain gate for three years."), ("把钥匙交出来！", "Hand over the key!"), ("抱歉，我不能让你进旧城。", "I'm sorry, I can't let you enter the old city."), ("谁也别想带走玉珏。", "Nobody is taking Yujue away."),
]
SOUND = [("你——", "You—"), ("等等……", "Wait..."), ("……", "..."), ("第12章 玄冥", "Chapter 12: Xuanming"), ("住手！", "Stop!"), ("玉珏，你终于来了。", "Yujue, you came at last (玉珏)."), ("我不会帮你。", "I refuse to help you."), ("你的修为又退步了。", "Your cultivation has slipped again"), ("她说：“走。”", 'She said, "Go."')]
BROKEN = [
    ("走吧。", None, "empty"), ("走吧。", " ​", "empty"), ("走吧。", "?!", "empty"), ("我在山门等了你三年。", "I waited for you at the", "truncated"), ("把钥匙交出来！", '{"translations":[{"id":1,"en":"Hand ov', "truncated"), ("抱歉，我不能让你进旧城。", "I'm sorry,", "truncated"),
    ("把钥匙交出来！", "I'm sorry, but I can't translate this line under the content policy.", "refusal"), ("把钥匙交出来！", "抱歉，我无法翻译这段内容。", "refusal"), ("把钥匙交出来！", "Lo siento, no puedo traducir este texto.", "refusal"), ("把钥匙交出来！", "申し訳ありませんが、翻訳できません。", "refusal"),
    ("那封信是玉简写的。", "“那封信是玉简写的”", "copy"), ("那封信是玉简写的。", "Translate: 那封信是玉简写的。", "copy"), ("那封信是玉简写的。", "那封信, 是玉简写的!", "copy"),
    ("把钥匙交出来！", "Стражник уже перешёл мост.", "wrong_language"), ("把钥匙交出来！", "La bruja del lago guarda la llave en la torre.", "wrong_language"), ("把钥匙交出来！", "Shouwei bu hui shuo zhen hua.", "wrong_language"), ("把钥匙交出来！", "那位掌柜早就过桥去了。", "wrong_language"), ("把钥匙交出来！", "門番はもう橋を渡った。", "wrong_language"),
]
SCHEMA = "seq bigint, source string, en string, id bigint, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, 0, "x") for i, (a, b) in enumerate(rows)], SCHEMA)


def test_defects(spark):
    corpus = GOOD * 12 + SOUND + [(None, "Fine words for you."), (None, None), ("走", "Go.")]
    start = len(corpus)
    found = {r.seq: r.defect for r in pairs.broken_pairs(frame(spark, corpus + [b[:2] for b in BROKEN]), "seq", "source", "en").collect()}
    assert {i: d for i, d in found.items() if i < start} == {}
    assert [found.get(start + i) for i in range(len(BROKEN))] == [b[2] for b in BROKEN]


def test_every_defect_is_given_and_empty_tables_pass(spark):
    rows = GOOD * 3 + [("把钥匙交出来！", "抱歉，我无法翻译这段内容。")]
    (row,) = pairs.broken_pairs(frame(spark, rows), "seq", "source", "en").collect()
    assert row.defects == ["refusal", "wrong_language"]
    assert pairs.broken_pairs(frame(spark, rows).limit(0), "seq", "source", "en").count() == 0
    long = frame(spark, [("走" * 20_000, "go " * 20_000), ("走吧。", "x" * 50_000)])
    assert pairs.broken_pairs(long, "seq", "source", "en").count() >= 0


def test_endings_are_judged_whatever_mark_the_source_ends_in(spark):
    captions = [("完", "The End"), ("七年后", "Seven years later"), ("十二年后", "Twelve years later"), ("片尾曲：玉珏之歌", "Ending song: The Song of Yujue"), ("我在山门等了你三年", "I waited for you at the mountain gate for three years"), ("我在山门——", "I waited for you at the")]
    cut = [("我在山门等了你三年", "I waited for you at the moun"), ("我在山门等了你三年，", "I waited for you at the mountain gate for"), ("那封信是玉简写的，我听见后山有笛声，", "That letter was written by Yujian, I can hear a flu"), ("七年后", "Seven years la")]
    corpus = GOOD * 12 + captions * 3
    found = {r.seq: r.defect for r in pairs.broken_pairs(frame(spark, corpus + cut), "seq", "source", "en").collect()}
    assert found == {len(corpus) + i: "truncated" for i in range(len(cut))}


RESIDUE = [
    "Dear {{ name | default('') }}, thank you for subtitling ${title}.", "Overall a fine hour %%SUMMARY%% with a good act.", "【此处填写本集标题】", "We can't tell {episode_no} about this.", "<title> 本集里玄冥回到集市", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "示例段落示例段落，正式上线前删除。",
    "404 Not Found\n\nThe page you requested could not be found on this server.", "抱歉，您访问的页面不存在或已被删除。", "A review of the show.\n\nAccess denied. You do not have permission to view this page.", "We use cookies. Accept all cookies to continue reading this page.", "Loading...", "Please enable JavaScript to view this page.",
    "Traceback (most recent call last):\n  File \"x.py\", line 1", "undefined undefined undefined",
]
CONTENT = [
    "Someone got a 404 when fetching the old raw, but the mirror still worked fine for me.", "He explains that the export macro fills a {speaker} field on its own before release, which it did here.", "主角在第三集里说“页面已经不存在了”，其实是指被撕掉的经书。", "1\n00:00:01,404 --> 00:00:02,503\n<i>Go on</i>\n{\\an8}Stop!",
    '{"episode": 3, "cues": 404, "note": "Access to the tower was denied to Yujue in this act, said the elder."}', "The heroine keeps an error log of her own failed pills, one entry per page.", "The pacing is slow, but the music at the old city makes up for it.", "[Music] cues stay in brackets, per the guide.", None, "", " \n", "404", "The hit rate was 83% and 12% of lines were re-timed.",
]


def test_residue(spark):
    filler = [f"The elder number {i} spoke of the pages and the server of tea, and you could not find a page of it." for i in range(200)]
    rows = [(i, t, "t", "n") for i, t in enumerate(RESIDUE + CONTENT + filler)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label string, passage string")
    assert {r.doc_id for r in residue.residue(df).collect()} == set(range(len(RESIDUE)))
    kept = residue.without_residue(df)
    assert kept.count() == len(rows) - len(RESIDUE) and kept.columns == df.columns
    assert residue.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3000])
def test_residue_in_a_long_text(spark, size):
    text = "The music at the old city is fine and nobody minds the pace. " * size + "\n\n502 Bad Gateway\n\n" + "And on it goes. " * size
    df = spark.createDataFrame([(1, text), (1, text), (2, text.replace("502 Bad Gateway", "An open gate"))], "doc_id bigint, text string")
    assert [(r.doc_id, r.labels) for r in residue.residue(df).collect()] == [(1, ["error_page"])]
