from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from teleledger.functions import clock, ids, paths, text
from teleledger.functions.titles import clean_title, series_title
from teleledger.operators.epg import channel_list

TITLES = [
    ("【連続テレビ小説】チョッちゃん（９６）[字]", "チョッちゃん"),
    ("雨と君と　＃１０【ヌマニメーション】[字]", "雨と君と"),
    ("転生宗主の覇道譚　～すべてを呑み込むサカナと這い上がる～＜Ｂ８＞　＃１０", "転生宗主の覇道譚 ~すべてを呑み込むサカナと這い上がる~"),
    ("Ｔｕｒｋｅｙ！　ＡｎｉｃｈＵ", "Turkey!"),
    ("日５「ウィッチウォッチ」　♯１５[字][デ]", "日5「ウィッチウォッチ」"),
    ("サンデーモーニング[字] “記録づくめ”酷暑に悲鳴▽記者殺害「ダブルタップ攻撃」とは", "サンデーモーニング"),
    ("フリースタイル・スノーボード・フリースキー世界選手権２０２５", "フリースタイル・スノーボード・フリースキー世界選手権2025"),
    ("架空名作劇場・人情刑事呉村安太郎[再]第1夜[字]", "架空名作劇場・人情刑事呉村安太郎"),
    ("【推しの子】　＃３０「アイドルと恋愛」", "【推しの子】"),
    ("カーリング女子世界選手権２０２５　予選リーグ「日本」対「韓国」", "カーリング女子世界選手権2025 予選リーグ「日本」対「韓国」"),
    ("映画『スーパーマリオ／魔界帝国の女神』　★大人気ゲームをハリウッドが実写化!?", "映画『スーパーマリオ"),
    ("ゴーストコンサート：missing Songs　＃2", "ゴーストコンサート"),
]


@pytest.mark.parametrize("raw,expected", TITLES)
def test_title(raw, expected):
    assert clean_title(raw) == expected


def test_title_on_spark(spark):
    df = spark.createDataFrame(TITLES + [(None, None)], "raw string, want string")
    rows = df.withColumn("got", series_title("raw")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


INVALID = [
    "/server/repo/not_double_slash_start", "///server/repo/too_many_slash", "//server//missing_repo_name",
    "//server/repo_no_trailing", "no_slash_prefix/server/repo", "//onlyserver", "not_full_path",
]


def test_paths(spark):
    good = ["//server/recorded/test1", "//s/f/", "//s/f/a/b/c", "//s/f/ａ b"]
    df = spark.createDataFrame([(p,) for p in INVALID + good + ["", None, "//s/f/a\nb"]], "p string")
    got = [r[0] for r in df.select(paths.is_valid(F.col("p"))).collect()]
    assert got == [False] * len(INVALID) + [True] * len(good) + [False, False, False]

    df = spark.createDataFrame([("//server/rec/a/b",), ("",), ("x/y",)], "p string")
    p = F.col("p")
    rows = df.select(paths.folder_of(p), paths.with_folder(p, F.lit("z")), paths.parent_of(p), paths.server_of(p)).collect()
    assert [tuple(r) for r in rows] == [
        ("rec", "//server/z/a/b", "//server/rec/a", "server"), (None, None, None, None), (None, None, "x", None)]
    assert spark.range(1).select(paths.from_recorder("\\\\nas", F.lit("\\rec\\a.ts"))).first()[0] == "//nas/rec/a.ts"


def test_contains(spark):
    df = spark.createDataFrame([("Test Program",), ("テスト番組2",), ("a\\b",), ("100%",)], "n string")
    find = lambda f, **k: [r.n for r in df.filter(text.contains(F.col("n"), f, **k)).collect()]
    assert find("test") == ["Test Program"]
    assert find("test", case_sensitive=True) == []
    assert find("テスト") == ["テスト番組2"]
    assert find("a\\b") == ["a\\b"]
    assert find("t_st") == ["Test Program"]


def test_headings(spark):
    raw = "lead\r\n- A\r\none\r\ntwo\r\n- B\r\n- A\r\nthree\n- C"
    row = spark.createDataFrame([(raw,), ("- X\nbody",), ("",)], "t string").select(
        text.headings(F.col("t")).alias("h"), text.heading_map(F.col("t")).alias("m")).collect()
    assert [(h.heading, h.body) for h in row[0].h] == [
        ("", "lead\n"), ("A", "one\ntwo\n"), ("B", ""), ("A", "three\n"), ("C", "")]
    assert row[0].m == {"": "lead\n", "A": "one\ntwo\n", "B": "", "A\t": "three\n", "C": ""}
    assert row[1].m == {"X": "body"}
    assert row[2].m == {}


def test_replies(spark):
    replies = ['```json\n{"title": "A"}\n```', 'Here: {"title": "B"} done', '{"title": ""}', "no", None, '{"title":null}']
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    assert [x[0] for x in df.select(text.title_from_reply(F.col("r"))).collect()] == ["A", "B", None, None, None, None]


def test_genre(spark):
    rows = spark.createDataFrame([("x\nジャンル : アニメ\r\ny",), ("none",), (None,), ("ジャンル　:　映画",)], "p string")
    assert [r[0] for r in rows.select(text.genre_of(F.col("p"))).collect()] == ["アニメ", None, None, "映画"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql(
            "SELECT TIMESTAMP_NTZ'2025-03-09 02:30:00.25' AS w, TIMESTAMP'2025-03-08 17:30:00.25Z' AS i").select(
            clock.epoch_micros(F.col("w"), True), clock.epoch_micros(F.col("i"), False),
            clock.epoch_millis(F.col("w"), True), clock.epoch_seconds(F.col("w"), True),
            clock.jst_date(F.col("w"), True).cast("string"), clock.jst_date(F.col("i"), False).cast("string"),
            (F.col("i") == clock.moment("2025-03-09 02:30:00.25", False)),
            (F.col("w") == clock.moment("2025-03-08T17:30:00.25+00:00", True)),
            F.unix_seconds(clock.to_instant(F.lit("2025-03-09T02:30:00"))),
            clock.epoch_micros(clock.from_micros(F.lit(1741455000250000), True), True),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    micros = 1741455000250000
    assert tuple(row) == (micros, micros, micros // 1000, micros // 10**6, "2025-03-09", "2025-03-09", True, True,
                          micros // 10**6, micros)


def test_json_times(spark):
    raw = '[1747018800, "2025-05-12T12:00:00+09:00", "2025-05-12T12:00:00", "x", 1.5, null]'
    got = spark.createDataFrame([(raw,), (None,), ("null",)], "j string").select(
        F.transform(clock.json_times(F.col("j")), F.unix_seconds)).collect()
    assert [r[0] for r in got] == [[1747018800, 1747018800, 1747018800], [], []]


def test_keys(spark):
    row = spark.range(1).select(
        ids.service_key(F.lit(4), F.lit(100), F.lit(101)),
        ids.matches_masked(F.lit(0x40064_0065), F.lit(0x40064_0000), F.lit(0xFFFF)),
        clock.file_time(F.timestamp_seconds(F.lit(0)), False), clock.file_time(F.timestamp_seconds(F.lit(1)), False, 9),
    ).first()
    assert tuple(row) == ((4 << 32) | (100 << 16) | 101, True, 116444736000000000, 116444736000000000 + 32401 * 10**7)


def test_channels(spark):
    lines = ["NHK\tnet\t4\t16625\t101\t1\t0\t1\t1", "short\t1", "bad\tnet\tx\t1\t1\t1\t1\t1\t1", "A\tB\t1\t2\t3\t4\t5\t0\t0\textra"]
    rows = channel_list(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in rows] == [
        ("NHK", "net", 4, 16625, 101, 1, False, True, True), ("A", "B", 1, 2, 3, 4, True, False, False)]


def test_listing_times(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2025-05-12 12:00:05' AS s, TIMESTAMP_NTZ'2025-05-12 12:30:00' AS e").select(
        clock.listing_time(F.col("s"), seconds=True), clock.listing_span(F.col("s"), F.col("e"))).first()
    assert tuple(row) == ("2025/05/12(Mon) 12:00:05", "2025/05/12(Mon) 12:00-12:30")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_listing_times_of_instants(spark, zone):
    """Japan time in every session, also in the hour that a session's zone has twice."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT TIMESTAMP'2025-11-02 05:30:05Z' AS s, TIMESTAMP'2025-11-02 06:30:00Z' AS e, CAST(NULL AS TIMESTAMP) AS n").select(
            clock.listing_time(F.col("s"), seconds=True, wall_clock=False), clock.listing_span(F.col("s"), F.col("e"), wall_clock=False),
            clock.listing_time(F.col("n"), wall_clock=False)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == ("2025/11/02(Sun) 14:30:05", "2025/11/02(Sun) 14:30-15:30", None)


def test_offsets_and_bare_dates(spark):
    from pyspark.sql import functions as F

    from teleledger.functions import clock

    noon = "2025-05-12T12:00:00"
    texts = [f"{noon}+0900", f"{noon}+09", f"{noon}+09:00", noon, "2025-05-12T03:00:00Z", "2025-05-12", "2025-05-12 12:00:00-0330", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.unix_seconds(clock.to_instant(F.col("t")))).collect()]
    at = 1747018800
    assert got == [at, at, at, at, at, at - 43200, 1747063800, None, None]


def test_reply_with_a_tail_is_invalid(spark):
    from pyspark.sql import functions as F

    from teleledger.functions import text

    replies = ['{"title":"a"} ok?', '{"title":"a"}', 'Sure: {"title":"b"} done']
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(text.title_from_reply(F.col("r"))).collect()
    assert [r[0] for r in got] == [None, "a", "b"]
