import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import process, text_jobs


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_mail_phone_and_national_id_are_masked(spark):
    assert one(spark, "연락 kim@x.co.kr 010-1234-5678 900101-1234567 끝", X.redact) == "연락 [이메일] [전화번호] [주민등록번호] 끝"


def test_negated_terms_are_no_hits(spark):
    hits = lambda c: X.active_hits(c, ["반대", "민원"])
    assert one(spark, "주민 반대의견이 없으므로 민원 처리", hits) == ["민원"]
    assert one(spark, "주민들은 반대했다", hits) == ["반대"]


def test_anchor_tiers(spark):
    tiers = lambda c: X.anchor_hits(c, ["태양광"], ["햇빛연금"], ["발전사업"], ["설치"])
    assert one(spark, "태 양 광 발전사업 설치", tiers) == ["태양광"]
    assert one(spark, "발전사업 설치", tiers) == ["발전사업"]
    assert one(spark, "발전사업 보고", tiers) == []


def test_sentences_keep_exact_offsets(spark):
    random.seed(1)
    texts = ["".join(random.choice(["가다", "요", ".", "!", " ", "\n", "ab", "\t", "🎉"]) for _ in range(random.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", X.sentence_spans(F.col("t")).alias("s"))
    for r in df.collect():
        ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s|$)|다(?=\s|$)|요(?=\s|$)|\n+", r.t)]
        want, start = [], 0
        for end in [*ends, len(r.t)]:
            raw = r.t[start:end]
            left, right = len(raw) - len(raw.lstrip()), len(raw.rstrip())
            if right > left:
                want.append((re.sub(r"[ \t]+", " ", raw[left:right]), start + left, start + right))
            start = end
        assert [(s.text, s.char_start, s.char_end) for s in r.s] == want, repr(r.t)


def test_paragraphs_are_packed_greedily(spark):
    got = one(spark, "가나. " * 20 + "\n\n짧다", lambda c: X.paragraphs(c, longest=20))
    assert all(len(p) <= 20 for p in got) and got[-1] == "짧다" and " ".join(got[:-1]).split() == ["가나."] * 20


PROVINCES = {"전남": "전라남도", "광주": "광주광역시"}
PROVINCE_OF = {"광양시": "전라남도", "영암군": "전라남도", "광산구": "광주광역시", "동구": "광주광역시"}


@pytest.mark.parametrize(
    ("address", "want"),
    [
        ("전남  영암군 삼호읍 용앙리 12", ("전라남도 영암군 삼호읍 용앙리 12", "전라남도", "영암군", "삼호읍", "용앙리", "ri")),
        ("전라남도영암군 덕진면", ("전라남도영암군 덕진면", "전라남도", "영암군", "덕진면", None, "eup_myeon")),
        ("두통합시 광양시", ("두통합시 광양시", "전라남도", "광양시", None, None, "city_county")),
        ("두통합시 없는시", ("두통합시 없는시", "전라남도", "없는시", None, None, "city_county")),
        ("광주광역시 동구", ("광주광역시 동구", "광주광역시", "동구", None, None, "city_county")),
        ("광산구", ("광산구", "광주광역시", "광산구", None, None, "city_county")),
        ("영암군 중앙로 12", ("영암군 중앙로 12", "전라남도", "영암군", None, None, "road_address")),
        ("강릉시", ("강릉시", None, "강릉시", None, None, "city_county")),
        ("전남", ("전라남도", "전라남도", None, None, None, "province")),
        ("1동 산12리", ("1동 산12리", None, None, "1동", "산12리", "ri")),
        ("", ("", None, None, None, None, "unknown")), (None, ("", None, None, None, None, "unknown")), ("12 somewhere", ("12 somewhere", None, None, None, None, "unknown")),
    ],
)
def test_addresses(spark, address, want):
    assert tuple(one(spark, address, lambda c: X.address_parts(c, PROVINCES, PROVINCE_OF, {"두통합시": "전라남도"}))) == want


def test_long_paragraphs_fill_lines_in_turn(spark):
    random.seed(3)
    texts = ["".join(random.choice(["가다. ", "요 ", "ab! ", "c", "길이가 있다 ", "\n\n", "x" * 30 + ". "]) for _ in range(random.randint(0, 300))) for _ in range(60)] + ["", "다. " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", X.paragraphs(F.col("t"), longest=40).alias("p"))
    for r in df.collect():
        want = []
        for part in re.split(X.PARAGRAPH_END, r.t):
            part = re.sub(r"[ \t\r\f\x0B]+", " ", part).strip()
            line = ""
            for piece in [part] if len(part) <= 40 else re.split(X.CUT_WITHIN, part):
                if line and len(line) + 1 + len(piece) > 40:
                    want.append(line)
                    line = piece
                else:
                    line = f"{line} {piece}".strip()
            want += [line] if line else []
        assert r.p == want


def test_units(spark):
    assert one(spark, "용량 1,200.5MW", lambda c: X.number_with_unit(c, r"용량 ([0-9][0-9,.]*)\s*(MW|kW)?", {"mw": 1000.0, "kw": 1.0})) == 1200500.0


def test_speaker_stop_names(spark):
    who = lambda c: X.speaker(c, ["위원장", "의원"], ["그러면"])
    assert tuple(one(spark, "○위원장 홍길동 회의를", who)) == ("위원장", "홍길동")
    assert tuple(one(spark, "○그러면 다음", who)) == (None, None)


def test_mentions_ignore_white_space_and_keep_offsets(spark):
    terms = spark.createDataFrame([("태양광발전",), ("발전",)], "term string")
    rows = text_jobs.mentions(spark.createDataFrame([(1, "새 태양 광 발전 시설 발전")], "k int, t string"), ["k"], "t", terms).collect()
    assert sorted((r.term, r.start_offset, r.end_offset) for r in rows) == [("발전", 7, 9), ("발전", 13, 15), ("태양광발전", 2, 9)]


def test_nested_speaker_markup(spark):
    html = "<h1>제1차 정례회 본회의 회의록입니다</h1><spk class='a'>○의원 <b>김<i>철수</i></b> 질의</spk><p>x</p><spk>답변</spk>"
    rows = text_jobs.html_segments(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").orderBy("ordinal").collect()
    assert [(r.segment_type, r.speaker_class, r.text) for r in rows] == [("agenda_or_header", None, "제1차 정례회 본회의 회의록입니다x"), ("speech", "a", "○의원 김철수 질의"), ("speech", None, "답변")]


def test_snippet_keeps_the_issue_sentence(spark):
    text = "예산을 늘렸습니다.\n빛반사 민원이 있습니다.\n다른 말입니다. " + "길다 " * 200
    df = spark.createDataFrame([(1, text)], "k int, t string")
    got = text_jobs.snippets(df, ["k"], "t", ["빛반사", "민원"], ["민원"], longest=60).first()["snippet"]
    assert "빛반사 민원이 있습니다." in got and "길다" not in got


def test_process_events_of_a_paragraph(spark):
    patterns = spark.createDataFrame([("complaint_received", 1, "민원"), ("investigation_or_review", 1, "현장\\s*점검"), ("resident_consultation", 1, "설명회")], "event_type string, priority int, pattern string")
    df = spark.createDataFrame([(1, "2024년 3월 5일 민원이 제기되었다."), (1, "현장 점검을 실시했다."), (1, "설명회를 열기로 예정이다.")], "k int, t string")
    rows = process.process_events(df, ["k"], "t", patterns, F.to_date(F.lit("2024-01-01")), [("resident", "주민")]).collect()
    got = {r.event_type: (str(r.event_date), r.outcome, r.certainty, r.confidence) for r in rows}
    assert got["complaint_received"] == ("2024-03-05", "reported", "confirmed", 0.86)
    assert got["investigation_or_review"] == ("2024-01-01", "completed", "confirmed", 0.86)
    assert got["resident_consultation"] == ("2024-01-01", "planned", "inferred", 0.72)


@pytest.mark.parametrize(
    ("html", "speeches", "outside"),
    [
        ("<spk class='a'>first speaker<br>says this</spk><p>outside text</p><spk class='b'>second speaker</spk>", [("a", "first speaker\nsays this"), ("b", "second speaker")], ["outside text"]),
        ("<spk class='a'>one <img src='x'> two<hr>three", [("a", "one \n two\nthree")], []),
        ("<div><spk class='a'>left <b>open</div><p>after it all</p>", [("a", "left open")], ["after it all"]),
        ("<spk class='a'>outer <spk class='b'>inner</spk> again</spk></i>plain words here", [("a", "outer again"), ("b", "inner")], ["plain words here"]),
        ("<spk/>self-closed paragraph", [], ["self-closed paragraph"]),
        ("", [], []),
    ],
)
def test_no_speech_is_lost_or_merged(spark, html, speeches, outside):
    rows = text_jobs.html_segments(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").orderBy("ordinal").collect()
    plain = lambda t: " ".join(t.split())
    assert [(r.speaker_class, plain(r.text)) for r in rows if r.segment_type == "speech"] == [(k, plain(t)) for k, t in speeches]
    assert [r.text for r in rows if r.segment_type != "speech"] == outside


def test_long_texts_have_all_sentence_offsets(spark):
    text = "Ein Satz. " * 3000 + "ohne Ende"
    rows = text_jobs.sentences(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string"), ["k"], "t").orderBy("sentence_order").collect()
    assert len(rows) == 3001 and all(text[r.char_start : r.char_end] == r.text for r in rows)


def test_python_sees_references_not_texts(spark):
    words = ["&amp;", "&eacute", "&notit;", "&#8211;", "&#x41", "&#0;", "&#x110000;", "&", "&;", "&&lt;", "& lt;", "x", " ", "\n", "&nosuchname;", "&#", "😀", "&😀x;", "&ngE;", "&#X1F600;", "é" * 40, "&" + "a" * 40, "&amp;lt;"]
    r = random.Random(7)
    texts = ["".join(r.choices(words, k=r.randrange(12))) for _ in range(400)] + [None, "", *words]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    made = rows.select("k", X.unescaped(F.col("t")).alias("u"))
    assert {x.k: x.u for x in made.collect()} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    assert X.unescape.returnType.simpleString() == "array<string>"
