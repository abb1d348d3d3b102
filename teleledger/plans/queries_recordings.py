"""Recording validation, patches and file commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleledger.functions import paths
from teleledger.operators import commands, recordings
from teleledger.plans.tables import Source, with_tables


def arrivals(s: Source) -> DataFrame:
    """One recording per line item; some suppliers deliver malformed paths."""
    line = s.read("lineitem")
    path = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("/nas/"), F.col("l_linestatus"), F.lit("/x")))
        .when(F.col("l_linestatus") == "F", F.concat(F.lit("//nas//"), F.col("l_partkey").cast("string")))
        .when(F.col("l_discount") == 0, F.concat(F.lit("//nas/"), F.col("l_suppkey").cast("string")))
        .otherwise(F.concat(F.lit("//nas/"), F.col("l_suppkey").cast("string"), F.lit("/"),
                            F.col("l_partkey").cast("string"))))
    return line.select(F.col("l_orderkey").alias("program_id"), F.col("l_linenumber").alias("line"),
                       path.alias("file_path"), F.col("l_shipdate").alias("created_at"))


_ARRIVALS = """arrivals AS (SELECT l_orderkey AS program_id, l_linenumber AS line, l_shipdate AS created_at,
    CASE WHEN l_returnflag = 'R' THEN '/nas/' || l_linestatus || '/x'
         WHEN l_linestatus = 'F' THEN '//nas//' || CAST(l_partkey AS VARCHAR)
         WHEN l_discount = 0 THEN '//nas/' || CAST(l_suppkey AS VARCHAR)
         ELSE '//nas/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) END AS file_path FROM lineitem)"""


def recording_validate(s: Source) -> DataFrame:
    return recordings.validate(arrivals(s))


RECORDING_VALIDATE = f"WITH {_ARRIVALS} SELECT *, regexp_full_match(file_path, '//[^/]+/[^/]+/.*') AS is_valid FROM arrivals"


def path_parts(s: Source) -> DataFrame:
    path = F.col("file_path")
    return arrivals(s).filter(path.isNotNull()).select(
        "program_id", "line", "file_path", paths.folder_of(path).alias("file_folder"),
        paths.server_of(path).alias("server"), paths.parent_of(path).alias("parent"),
        paths.with_folder(path, F.lit("moved")).alias("moved"),
        paths.in_folder(path, "[0-9]+").alias("numbered"))


PATH_PARTS = f"""WITH {_ARRIVALS} SELECT program_id, line, file_path,
    CASE WHEN len(string_split(file_path, '/')) > 3 THEN string_split(file_path, '/')[4] END AS file_folder,
    CASE WHEN file_path LIKE '//%' THEN string_split(file_path, '/')[3] END AS server,
    nullif(regexp_extract(file_path, '^(.*)/', 1), '') AS parent,
    CASE WHEN len(string_split(file_path, '/')) > 3 THEN array_to_string(list_concat(list_concat(
        string_split(file_path, '/')[1:3], ['moved']), string_split(file_path, '/')[5:]), '/') END AS moved,
    regexp_matches(file_path, '^//[^/]+/[0-9]+/.*$') AS numbered FROM arrivals"""


def patches(s: Source) -> DataFrame:
    """Every event is one patch of one of the first recordings of its program."""
    kind, odd = F.col("event_type"), F.col("value") > 10
    program = F.expr("event_id div 100 * 10 + user_id % 10")
    return s.read("events").select(
        (program * 10 + F.expr("user_id div 10 % 3") + 1).alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", F.when(odd, F.concat(F.lit("//nas2/kept/"), F.col("event_id").cast("string")))
               .otherwise("//nas2")).alias("file_path"),
        (kind == "signup").alias("file_path_set"),
        F.when((kind == "click") & odd, "archives").when(kind == "click", "shelf").alias("file_folder"),
        (kind == "click").alias("file_folder_set"),
        F.when(kind == "view", F.col("ts")).alias("watched_at"),
        (kind.isin("view", "error")).alias("watched_at_set"),
        F.when((kind == "purchase") & odd, F.col("ts")).alias("deleted_at"),
        (kind == "purchase").alias("deleted_at_set"),
    )


_PATCHES = """patches AS (SELECT (event_id // 100 * 10 + user_id % 10) * 10 + user_id // 10 % 3 + 1 AS id, event_id AS seq,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value > 10 THEN '//nas2/kept/' || CAST(event_id AS VARCHAR) ELSE '//nas2' END END AS new_path,
    event_type = 'signup' AS path_set,
    CASE WHEN event_type = 'click' THEN CASE WHEN value > 10 THEN 'archives' ELSE 'shelf' END END AS folder,
    event_type = 'click' AS folder_set, CASE WHEN event_type = 'view' THEN ts END AS new_watched,
    event_type IN ('view', 'error') AS watched_set,
    CASE WHEN event_type = 'purchase' AND value > 10 THEN ts END AS new_deleted,
    event_type = 'purchase' AS deleted_set FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM patches),
steps AS (
    SELECT id, program_id, 0 AS k, CAST(-1 AS BIGINT) AS seq, 0 AS status, file_path AS old_path, file_path AS path, file_size,
        watched_at, deleted_at, created_at, false AS deletes, false AS moves FROM recordings
    UNION ALL
    SELECT j.id, j.program_id, j.k, j.seq, j.status, j.old_path,
        CASE WHEN j.status <> 200 THEN j.old_path WHEN j.deletes THEN '' WHEN j.folder_set
             THEN regexp_replace(j.old_path, '^(//[^/]*/)[^/]*', '\\1' || j.folder)
             WHEN j.path_set THEN j.new_path ELSE j.old_path END,
        CASE WHEN j.status = 200 AND j.deletes THEN NULL ELSE j.file_size END,
        CASE WHEN j.status = 200 AND j.watched_set THEN j.new_watched ELSE j.watched_at END,
        CASE WHEN j.status = 200 AND j.deleted_set THEN j.new_deleted ELSE j.deleted_at END,
        j.created_at, j.deletes, j.moves
    FROM (SELECT s.id, s.program_id, p.k, p.seq, s.path AS old_path, s.file_size, s.watched_at, s.deleted_at, s.created_at,
            p.new_path, p.path_set, p.folder, p.folder_set, p.new_watched, p.watched_set, p.new_deleted, p.deleted_set,
            p.new_deleted IS NOT NULL AS deletes, p.folder_set AS moves,
            CASE WHEN p.folder_set AND s.path = '' THEN 404
                 WHEN p.path_set AND NOT regexp_full_match(p.new_path, '//[^/]+/[^/]+/.*') THEN 400
                 ELSE 200 END AS status
          FROM steps s JOIN ranked p ON p.id = s.id AND p.k = s.k + 1) j)"""


def recording_patch(s: Source) -> DataFrame:
    after, _ = recordings.patch_recordings(s.recordings, patches(s))
    return after


RECORDING_PATCH = with_tables(f""", {_PATCHES}
SELECT id, program_id, path AS file_path, file_size, watched_at, deleted_at, created_at FROM steps
QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""", "recordings", recursive=True)


def patch_outcomes(s: Source) -> DataFrame:
    return recordings.judge_patches(s.recordings, patches(s)).select("id", "seq", "status", "old_path", "new_path")


PATCH_OUTCOMES = with_tables(f""", {_PATCHES}
SELECT id, seq, status, old_path, path AS new_path FROM steps WHERE k > 0
UNION ALL SELECT id, seq, 404, NULL, NULL FROM patches WHERE id NOT IN (SELECT id FROM recordings)""",
    "recordings", recursive=True)


def file_commands(s: Source) -> DataFrame:
    return commands.file_commands(recordings.judge_patches(s.recordings, patches(s)))


FILE_COMMANDS = with_tables(f""", {_PATCHES}
SELECT id, seq, CASE WHEN deletes THEN 'delete' ELSE 'rename' END AS action,
    CASE WHEN deletes THEN old_path END AS file_path, CASE WHEN NOT deletes THEN old_path END AS old_path,
    CASE WHEN NOT deletes THEN path END AS new_path,
    CASE WHEN deletes THEN '{{"action":"delete","file_path":"' || old_path || '"}}'
         ELSE '{{"action":"rename","old_path":"' || old_path || '","new_path":"' || path || '"}}' END AS value
FROM steps WHERE k > 0 AND status = 200 AND ((deletes AND old_path <> '') OR (moves AND old_path <> path))""",
    "recordings", recursive=True)


def command_messages(s: Source) -> DataFrame:
    """Intake of the commands above together with text that is no command: every event's own payload. A row per message."""
    queued = file_commands(s).select("value").unionByName(s.read("events").select(F.col("props").alias("value")))
    return commands.route_commands(commands.parse_commands(queued)).select("route", "about_path", "make_folder")


def command_routes(s: Source) -> DataFrame:
    """The messages counted by route and folder."""
    return command_messages(s).groupBy("route", "make_folder").agg(
        F.count("*").alias("n"), F.min("about_path").alias("first_path"))


_QUEUED = f""", {_PATCHES},
queued AS (SELECT CASE WHEN deletes THEN 'delete' ELSE 'rename' END AS route, old_path AS about_path,
        CASE WHEN NOT deletes THEN regexp_extract(path, '^(.*)/', 1) END AS make_folder
    FROM steps WHERE k > 0 AND status = 200 AND ((deletes AND old_path <> '') OR (moves AND old_path <> path))
    UNION ALL SELECT CASE WHEN props LIKE '{{%' THEN 'ignore' ELSE 'dead_letter' END, NULL, NULL FROM events)
"""
COMMAND_MESSAGES = with_tables(f"{_QUEUED}SELECT route, about_path, make_folder FROM queued", "recordings", recursive=True)
COMMAND_ROUTES = with_tables(f"""{_QUEUED}SELECT route, make_folder, count(*) AS n, min(about_path) AS first_path FROM queued GROUP BY route, make_folder""",
    "recordings", recursive=True)

QUERIES = {
    "recording_validate": (recording_validate, RECORDING_VALIDATE),
    "path_parts": (path_parts, PATH_PARTS),
    "recording_patch": (recording_patch, RECORDING_PATCH),
    "patch_outcomes": (patch_outcomes, PATCH_OUTCOMES),
    "file_commands": (file_commands, FILE_COMMANDS),
    "command_messages": (command_messages, COMMAND_MESSAGES),
    "command_routes": (command_routes, COMMAND_ROUTES),
}
