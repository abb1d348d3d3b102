"""Series: searches, edits, and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.functions import text
from teleledger.functions.titles import series_title
from teleledger.operators import series
from teleledger.plans.queries_search import _FILED, _NESTED, _VIEWED, _flat
from teleledger.plans.tables import Source, with_tables

_NOW = "2024-06-01 00:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp_ntz")


def series_search(s: Source) -> DataFrame:
    return series.search_series(s.series, name="RI", page=2, size=5)


SERIES_SEARCH = with_tables("""SELECT id, name, created_at, modified_at FROM series WHERE name ILIKE '%RI%'
ORDER BY modified_at DESC, id LIMIT 5 OFFSET 5""", "series")


def series_programs(s: Source) -> DataFrame:
    found = series.series_programs(s.series, s.program_series, s.programs, s.views, s.recordings, page=2, size=40)
    return _flat(found, "series_id", "series_name", "id", "name", "start_time", "duration", "end_time")


SERIES_PROGRAMS = with_tables(f""", {_VIEWED}, {_FILED}, placed AS (SELECT l.series_id, l.program_id, row_number() OVER (
    PARTITION BY l.series_id ORDER BY p.start_time DESC, l.program_id) AS place
    FROM program_series l JOIN programs p ON p.id = l.program_id)
SELECT l.series_id, s.name AS series_name, p.id, p.name, p.start_time, p.duration,
    p.start_time + to_seconds(p.duration) AS end_time, {_NESTED}
FROM placed l JOIN series s ON s.id = l.series_id JOIN programs p ON p.id = l.program_id
LEFT JOIN va ON va.program_id = p.id LEFT JOIN ra ON ra.program_id = p.id WHERE place BETWEEN 41 AND 80""",
    "programs", "views", "recordings", "series", "program_series")


def series_heads(s: Source) -> DataFrame:
    """Keys: one per part, which name series and others; programs of up to half an hour are gone."""
    keys = s.read("part").select(F.col("p_partkey").alias("series_id"))
    return series.series_heads(s.series, s.program_series, s.programs.filter("duration > 1800"), keys)


SERIES_HEADS = with_tables(""", counted AS (SELECT series_id, count(DISTINCT program_id) AS n FROM program_series
    WHERE program_id IN (SELECT id FROM programs WHERE duration > 1800) GROUP BY series_id)
SELECT k.series_id, s.name AS series_name, s.created_at, s.modified_at,
    CASE WHEN s.id IS NULL THEN 0 ELSE coalesce(c.n, 0) END AS n_programs, s.id IS NOT NULL AS known
FROM (SELECT DISTINCT p_partkey AS series_id FROM part) k LEFT JOIN series s ON s.id = k.series_id
LEFT JOIN counted c ON c.series_id = k.series_id""", "programs", "series", "program_series")


def series_get_or_create(s: Source) -> DataFrame:
    """Wanted: a name per part from its brand and kind; some are series already."""
    part = s.read("part")
    wanted = part.select(
        F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat("p_brand", F.lit(" "), "p_type")).alias("name"),
        F.timestamp_add("DAY", F.col("p_partkey"), F.lit("2010-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.col("p_partkey").alias("seq"))
    after, _ = series.get_or_create(s.series, wanted)
    return after


SERIES_GET_OR_CREATE = with_tables(""", wanted AS (SELECT CASE WHEN p_size > 25 THEN p_name ELSE p_brand || ' ' || p_type END AS name,
    min(p_partkey) AS seq FROM part GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS id, name, created_at, modified_at FROM series
UNION ALL SELECT sha256('series|' || name), name, TIMESTAMP '2010-01-01' + to_days(CAST(seq AS INTEGER)),
    TIMESTAMP '2010-01-01' + to_days(CAST(seq AS INTEGER)) FROM wanted WHERE name NOT IN (SELECT name FROM series)""", "series")


def _link_requests(s: Source) -> DataFrame:
    """Every line item asks to link its order to a series numbered by its supplier; many of those do not exist."""
    return s.read("lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("program_id"), F.col("l_shipdate").alias("at"))


def series_link(s: Source) -> DataFrame:
    """The series afterwards."""
    after, _, _ = series.link_programs(s.series, s.program_series, s.programs, _link_requests(s))
    return after


SERIES_LINK = with_tables("""SELECT s.id, s.name, s.created_at, greatest(s.modified_at, coalesce(x.at_, s.modified_at)) AS modified_at
FROM series s LEFT JOIN (SELECT l_suppkey AS id, max(l_shipdate) AS at_ FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1) x ON x.id = s.id""", "series")


def series_links(s: Source) -> DataFrame:
    """All links afterwards."""
    _, links, _ = series.link_programs(s.series, s.program_series, s.programs, _link_requests(s))
    return links


SERIES_LINKS = with_tables("""SELECT program_id, series_id FROM program_series
UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT id FROM series)
    AND l_orderkey IN (SELECT id FROM programs)""", "programs", "series", "program_series")


def series_link_refused(s: Source) -> DataFrame:
    _, _, refused = series.link_programs(s.series, s.program_series, s.programs, _link_requests(s))
    return refused


SERIES_LINK_REFUSED = with_tables("""SELECT l_suppkey AS series_id, l_orderkey AS program_id, max(l_shipdate) AS "at",
    'Not found: series' AS reason FROM lineitem WHERE l_suppkey NOT IN (SELECT id FROM series) GROUP BY 1, 2""", "series")


def _renames(s: Source) -> DataFrame:
    """Every series gets a name: its own, that of another series, or one several of them share."""
    first = F.substring_index("name", " ", 1)
    last = F.substring_index("name", " ", -1)
    new = (F.when(first == "small", F.concat(F.lit("large "), last))
           .when(first == "old", "vintage").when(last == "gizmo", F.concat(first, F.lit(" gadget")))
           .otherwise(F.col("name")))
    return s.series.select(F.col("id").alias("series_id"), new.alias("name"), _now().alias("at"), F.col("id").alias("seq"))


def _one_by_one(asked: str) -> str:
    """The edits of ``asked`` (id, name, seq) one after the other: the rule as it reads. ``judged`` has the status of each, ``ended`` the
    series that are left, and ``heads`` where each series' links are."""
    return f"""asked AS ({asked}),
ranked AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM asked),
steps AS (
    SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS target,
        (SELECT list({{'id': id, 'name': name, 'edited': false}}) FROM series) AS alive, (SELECT list({{'id': id, 'head': id}}) FROM series) AS heads
    UNION ALL
    SELECT k, id, name, status, CASE status WHEN 'merged' THEN holder WHEN 'not_found' THEN NULL ELSE id END,
        CASE status WHEN 'renamed' THEN list_transform(alive, lambda x: CASE WHEN x.id = j.id THEN {{'id': x.id, 'name': j.name, 'edited': true}} ELSE x END)
            WHEN 'merged' THEN list_filter(alive, lambda x: x.id <> j.id) ELSE alive END,
        CASE status WHEN 'merged' THEN list_transform(heads, lambda x: CASE WHEN x.head = j.id THEN {{'id': x.id, 'head': j.holder}} ELSE x END) ELSE heads END
    FROM (SELECT *, CASE WHEN NOT there THEN 'not_found' WHEN holder IS NULL THEN 'renamed' WHEN holder = id THEN 'unchanged' ELSE 'merged' END AS status
        FROM (SELECT r.k, r.id, r.name, s.alive, s.heads, len(list_filter(s.alive, lambda x: x.id = r.id)) > 0 AS there,
                list_min(list_transform(list_filter(s.alive, lambda x: x.name = r.name), lambda x: x.id)) AS holder
            FROM steps s JOIN ranked r ON r.k = s.k + 1) i) j),
judged AS (SELECT id, name, status, target FROM steps WHERE k > 0),
last AS (SELECT * FROM steps QUALIFY row_number() OVER (ORDER BY k DESC) = 1),
ended AS (SELECT unnest(alive) AS x FROM last),
heads AS (SELECT unnest(heads) AS x FROM last)"""


_ASKED = """SELECT id, CASE WHEN split_part(name, ' ', 1) = 'small' THEN 'large ' || split_part(name, ' ', 2)
    WHEN split_part(name, ' ', 1) = 'old' THEN 'vintage'
    WHEN split_part(name, ' ', 2) = 'gizmo' THEN split_part(name, ' ', 1) || ' gadget' ELSE name END AS name, id AS seq FROM series"""
_SERIES_AFTER = f"""SELECT s.id, e.x.name AS name, s.created_at, CASE WHEN e.x.edited THEN TIMESTAMP '{_NOW}' ELSE s.modified_at END AS modified_at
FROM series s JOIN ended e ON e.x.id = s.id"""
_LINKS_AFTER = "SELECT DISTINCT l.program_id, h.x.head AS series_id FROM program_series l JOIN heads h ON h.x.id = l.series_id"


def series_rename(s: Source) -> DataFrame:
    """The series afterwards: merged ones gone, renamed ones with their new name."""
    return series.rename_or_merge(s.series, s.program_series, _renames(s)).series


SERIES_RENAME = with_tables(f", {_one_by_one(_ASKED)} {_SERIES_AFTER}", "series", recursive=True)


def series_merge(s: Source) -> DataFrame:
    """The links afterwards."""
    return series.rename_or_merge(s.series, s.program_series, _renames(s)).links


SERIES_MERGE = with_tables(f", {_one_by_one(_ASKED)} {_LINKS_AFTER}", "series", "program_series", recursive=True)


def series_rename_outcome(s: Source) -> DataFrame:
    return series.rename_or_merge(s.series, s.program_series, _renames(s)).outcome.select("series_id", "name", "status", "target")


SERIES_RENAME_OUTCOME = with_tables(f", {_one_by_one(_ASKED)} SELECT id AS series_id, name, status, target FROM judged", "series", recursive=True)


def _edits(s: Source) -> DataFrame:
    """Many edits of each series in turn: parts give names, which are released, taken again, and asked for by others; some series do not exist."""
    part = s.read("part")
    name = (F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("part "), (F.col("p_partkey") % 40).cast("string")))
            .when(F.col("p_size") % 3 == 1, F.concat_ws(" ", F.substring_index("p_name", " ", 1), F.lit("gadget")))
            .otherwise(F.concat(F.lit("part "), F.col("p_partkey").cast("string"))))
    return part.select((F.col("p_partkey") * 7 % 61).alias("series_id"), name.alias("name"), _now().alias("at"), F.col("p_partkey").alias("seq"))


_ASKED_OFTEN = """SELECT p_partkey * 7 % 61 AS id, CASE WHEN p_size % 3 = 0 THEN 'part ' || (p_partkey % 40)
    WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 1) || ' gadget' ELSE 'part ' || p_partkey END AS name, p_partkey AS seq FROM part"""


def series_edits(s: Source) -> DataFrame:
    """The series after a batch in which edits depend on each other."""
    return series.rename_or_merge(s.series, s.program_series, _edits(s)).series


SERIES_EDITS = with_tables(f", {_one_by_one(_ASKED_OFTEN)} {_SERIES_AFTER}", "series", recursive=True)


def series_edits_links(s: Source) -> DataFrame:
    """The links after it: merged series may have merged on."""
    return series.rename_or_merge(s.series, s.program_series, _edits(s)).links


SERIES_EDITS_LINKS = with_tables(f", {_one_by_one(_ASKED_OFTEN)} {_LINKS_AFTER}", "series", "program_series", recursive=True)


def series_edits_outcome(s: Source) -> DataFrame:
    done = series.rename_or_merge(s.series, s.program_series, _edits(s)).outcome
    return done.select("seq", "series_id", "name", "status", "target")


SERIES_EDITS_OUTCOME = with_tables(f""", {_one_by_one(_ASKED_OFTEN)}
SELECT r.seq, r.id AS series_id, r.name, s.status, s.target FROM ranked r JOIN steps s ON s.k = r.k""", "series", recursive=True)


def _moves(s: Source) -> DataFrame:
    """The link with the smallest series of every program moves to a series named after the order's status or priority."""
    least = s.program_series.groupBy("program_id").agg(F.min("series_id").alias("series_id"))
    orders = s.read("orders").select(F.col("o_orderkey").alias("program_id"), "o_orderstatus", "o_orderpriority")
    name = (F.when(F.col("o_orderstatus") == "O", "hot bolt").when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
            .otherwise(""))
    return least.join(orders, "program_id").select(
        "program_id", "series_id", name.alias("name"), _now().alias("at"), F.col("program_id").alias("seq"))


_MOVED = f""", asked AS (SELECT l.program_id, min(l.series_id) AS series_id, CASE WHEN any_value(o_orderstatus) = 'O' THEN 'hot bolt'
    WHEN any_value(o_orderstatus) = 'F' THEN any_value(o_orderpriority) ELSE '' END AS name
    FROM program_series l JOIN orders ON o_orderkey = l.program_id GROUP BY l.program_id),
made AS (SELECT DISTINCT a.name, coalesce(CAST(s.id AS VARCHAR), sha256('series|' || a.name)) AS target
    FROM asked a LEFT JOIN series s ON s.name = a.name WHERE a.name <> '')"""


def series_move(s: Source) -> DataFrame:
    """The links afterwards."""
    return series.move_programs(s.series, s.program_series, _moves(s)).links


SERIES_MOVE = with_tables(f"""{_MOVED}
SELECT DISTINCT CAST(l.program_id AS VARCHAR) AS program_id, coalesce(m.target, CAST(l.series_id AS VARCHAR)) AS series_id
FROM program_series l LEFT JOIN asked a ON a.program_id = l.program_id AND a.series_id = l.series_id
LEFT JOIN made m ON m.name = a.name""", "series", "program_series")


def series_move_series(s: Source) -> DataFrame:
    """The series afterwards."""
    return series.move_programs(s.series, s.program_series, _moves(s)).series


SERIES_MOVE_SERIES = with_tables(f"""{_MOVED}
SELECT CAST(id AS VARCHAR) AS id, name, created_at, modified_at FROM series
UNION ALL SELECT target, name, TIMESTAMP '{_NOW}', TIMESTAMP '{_NOW}' FROM made WHERE name NOT IN (SELECT name FROM series)""",
    "series", "program_series")


def _move_chains(s: Source) -> DataFrame:
    """Each program's line items move its links on from series to series, in order of their numbers."""
    names = s.series.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    names = F.broadcast(names.filter("id between -10 and 12"))  # all that a remainder of 12 can ask for
    line = s.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    line = line.select(
        F.col("l_orderkey").alias("program_id"), (F.col("l_suppkey") % 12 + 1).cast("long").alias("series_id"),
        (F.col("l_partkey") % 12 + 1).cast("long").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return line.join(names, "id").select("program_id", "series_id", "name", _now().alias("at"), "seq")


def series_move_chain(s: Source) -> DataFrame:
    """The links after several moves of each program, one leading on to the other."""
    return series.move_programs(s.series, s.program_series, _move_chains(s)).links


SERIES_MOVE_CHAIN = with_tables(""", named AS (SELECT min(id) AS id, name FROM series GROUP BY name),
asked AS (SELECT l_orderkey AS program_id, l_suppkey % 12 + 1 AS source, n.id AS target,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k
    FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)
    JOIN named n ON n.id = l_partkey % 12 + 1),
steps AS (
    SELECT program_id, series_id AS origin, series_id AS place, CAST(0 AS BIGINT) AS k FROM program_series
    UNION ALL
    SELECT s.program_id, s.origin, CASE WHEN a.source = s.place THEN a.target ELSE s.place END, a.k
    FROM steps s JOIN asked a ON a.program_id = s.program_id AND a.k = s.k + 1),
ended AS (SELECT program_id, place FROM steps QUALIFY row_number() OVER (PARTITION BY program_id, origin ORDER BY k DESC) = 1)
SELECT DISTINCT CAST(program_id AS VARCHAR) AS program_id, CAST(place AS VARCHAR) AS series_id FROM ended""", "series", "program_series", recursive=True)


# ---- titles ----

def _names(s: Source) -> DataFrame:
    """Program names, page titles and the first message of conversations as program names, whole."""
    page_title = F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit(""))
    shows = s.programs.select("name")
    pages = s.read("pages").select(page_title.alias("name")).filter("name IS NOT NULL")
    talk = s.read("conversations").select(F.col("text").alias("name"))
    return shows.unionByName(pages).unionByName(talk)


def title_extract(s: Source) -> DataFrame:
    names = _names(s).select("name").distinct()
    return names.select("name", series_title(F.col("name")).alias("title"))


# The title rules, in their order, for DuckDB's regular expressions: no look-around, and ``$`` spelled out as Python reads it.
_SQL_RULES = [
    (r"^\s+|\s+$", "", "g"), (r"\[[^\]]+\]", "", "g"), (r"【[^】]+】", "", "g"), (r"(?-s)[（(<].*?[）)>]", "", "g"),
    (r"第?[\d一二三四五六七八九十百]+[期章部回話目夜節]", " ", "g"),
    (r"(?i)(?:Season|Part|Vol|Volume|#|＃|♯)\.?\s*\d+", " ", "g"), (r"(?i)\d+(?:st|nd|rd|th)\s*Season", " ", "g"),
    (r"\s+[IVXLCDMivxlcdm]+(?:\s|\z|\[|（|「|【)", " ", "g"), (r"(\S)[IVXLCDMivxlcdm]+(\n?)\z", r"\1 \2", ""),
    (r"(?-s)\s+([\"“★☆▽▼「『(（\[【].*)", " ", "g"), (r"(?-s)\s*[:：〜～\-－/／]{1,2}\s*.*(\n?)\z", r"\1", ""),
    (r"(?-s)\s+(?:決定戦|SP|スペシャル|総集編|見どころ|オリジナル版|特別編).*(\n?)\z", r"\1", ""),
    (r"[-–――—〜～\s]+\z", "", ""), (r"^\s+[-–――—〜～\s]+", "", ""), (r"\s{2,}", " ", "g"),
    (r"(?i)AnichU+(\n?)\z", r"\1", ""), (r"^\s+|\s+$", "", "g"),
]


def _sql_title(column: str) -> str:
    for pattern, replacement, flags in _SQL_RULES:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}'{chr(44) + repr(flags) if flags else ''})"
    return column


TITLE_EXTRACT = with_tables(f""", names AS (SELECT name FROM programs
    UNION SELECT nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') FROM pages UNION SELECT text FROM conversations)
SELECT name, {_sql_title("name")} AS title FROM names WHERE name IS NOT NULL""", "programs")


def program_titles(s: Source) -> DataFrame:
    """Titles of all program names; where a part is called like one, its stored answer wins."""
    told = s.read("part").select(
        F.concat(F.lit("Show 1-URGENT #"), (F.col("p_partkey") % 12 + 1).cast("string")).alias("name"),
        F.concat(F.lit('```json\n{"title": "'), F.substring_index("p_name", " ", 1), F.lit('"}\n```')).alias("reply"))
    return series.titles_of(s.programs, told)


PROGRAM_TITLES = with_tables(""", told AS (SELECT 'Show 1-URGENT #' || CAST(p_partkey % 12 + 1 AS VARCHAR) AS name,
    max(split_part(p_name, ' ', 1)) AS title FROM part GROUP BY 1)
SELECT DISTINCT p.name, coalesce(t.title, trim(regexp_replace(regexp_replace(p.name, '(?i)#\\s*\\d+', ' ', 'g'), '\\s*-.*$', ''))) AS title
FROM programs p LEFT JOIN told t ON t.name = p.name""", "programs")


def title_replies(s: Source) -> DataFrame:
    """Titles out of stored model replies, fenced or bare, with talk around them, or no JSON at all."""
    part = s.read("part")
    body = F.concat(F.lit('{"title": "'), F.col("p_name"), F.lit('"}'))
    reply = (F.when(F.col("p_size") < 10, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(F.col("p_size") < 20, F.concat(F.lit("Sure: "), body, F.lit(" ok?")))
             .when(F.col("p_size") < 30, body).otherwise(F.col("p_name")))
    return part.select("p_partkey", text.title_from_reply(reply).alias("title"))


TITLE_REPLIES = "SELECT p_partkey, CASE WHEN p_size < 30 THEN p_name END AS title FROM part"


def series_assign(s: Source) -> DataFrame:
    """Links of all programs with the series their names stand for, next to the links they had."""
    rows = s.programs.select(F.col("id").alias("program_id"), "name", "created_at", F.col("id").alias("seq"))
    return series.assign_series(s.programs, s.series, s.program_series, rows).links


SERIES_ASSIGN = with_tables("""SELECT CAST(program_id AS VARCHAR) AS program_id, CAST(series_id AS VARCHAR) AS series_id FROM program_series
UNION ALL SELECT CAST(id AS VARCHAR), sha256('series|' || trim(regexp_replace(regexp_replace(name, '(?i)#\\s*\\d+', ' ', 'g'), '\\s*-.*$', '')))
FROM programs""", "programs", "series", "program_series")


def series_assign_series(s: Source) -> DataFrame:
    """The series after the same step."""
    rows = s.programs.select(F.col("id").alias("program_id"), "name", "created_at", F.col("id").alias("seq"))
    return series.assign_series(s.programs, s.series, s.program_series, rows).series


SERIES_ASSIGN_SERIES = with_tables(""", titled AS (SELECT id, created_at,
    trim(regexp_replace(regexp_replace(name, '(?i)#\\s*\\d+', ' ', 'g'), '\\s*-.*$', '')) AS title FROM programs)
SELECT CAST(id AS VARCHAR) AS id, name, created_at, modified_at FROM series
UNION ALL SELECT sha256('series|' || title), title, arg_min(created_at, id), max(created_at) FROM titled GROUP BY title""",
    "programs", "series")

QUERIES = {
    "series_search": (series_search, SERIES_SEARCH),
    "series_programs": (series_programs, SERIES_PROGRAMS),
    "series_heads": (series_heads, SERIES_HEADS),
    "series_get_or_create": (series_get_or_create, SERIES_GET_OR_CREATE),
    "series_link": (series_link, SERIES_LINK),
    "series_links": (series_links, SERIES_LINKS),
    "series_link_refused": (series_link_refused, SERIES_LINK_REFUSED),
    "series_rename": (series_rename, SERIES_RENAME),
    "series_merge": (series_merge, SERIES_MERGE),
    "series_rename_outcome": (series_rename_outcome, SERIES_RENAME_OUTCOME),
    "series_edits": (series_edits, SERIES_EDITS),
    "series_edits_links": (series_edits_links, SERIES_EDITS_LINKS),
    "series_edits_outcome": (series_edits_outcome, SERIES_EDITS_OUTCOME),
    "series_move_chain": (series_move_chain, SERIES_MOVE_CHAIN),
    "series_move": (series_move, SERIES_MOVE),
    "series_move_series": (series_move_series, SERIES_MOVE_SERIES),
    "title_extract": (title_extract, TITLE_EXTRACT),
    "program_titles": (program_titles, PROGRAM_TITLES),
    "title_replies": (title_replies, TITLE_REPLIES),
    "series_assign": (series_assign, SERIES_ASSIGN),
    "series_assign_series": (series_assign_series, SERIES_ASSIGN_SERIES),
}
