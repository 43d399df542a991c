"""Text queries: chat, names, obituaries, settings and directives, on lines derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arenalake.functions import text as X
from arenalake.operators import filters as V
from arenalake.operators import kills as K
from arenalake.sources.lens import SQL, Lens


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Lens(spark, sf_dir).messages
    line = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("("), "player", F.lit("): "), "message")).when(F.col("seq") % 3 == 1, F.concat("player", F.lit(": "), "message")).otherwise(F.concat(F.lit("["), "message"))
    out = m.select("match_id", "seq", X.parse_chat(line).alias("c")).filter("c is not null")
    return out.select("match_id", "seq", "c.type", "c.player", F.sha2("c.text", 256).alias("text_sha"))


def chat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Lens(spark, sf_dir).messages
    rows = m.select("match_id", F.floor(F.col("seq") / 2).cast("int").alias("t_ms"), F.lit("chat").alias("type"), "player", "message")
    return V.distinct_chat(rows.unionByName(rows))


def chat_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Lens(spark, sf_dir).messages
    return m.select("match_id", "seq", F.sha2(X.strip_markup(F.concat(F.lit("\r{&cf00"), "message", F.lit("&r} !A"))), 256).alias("clean_sha"))


def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).table("customer").select("c_custkey", X.normalize_name("c_name").alias("name"))


def normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).table("part").select("p_partkey", X.normalize(F.translate("p_name", "aeo", "á\u0012\u008d")).alias("name"))


def obituaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Death messages written from the kill log and read back."""
    f = Lens(spark, sf_dir).frag_log
    line = F.when(F.col("is_suicide"), F.concat("victim", F.lit(" discovers blast radius")))
    for weapon, phrase, tail in (("rl", " rides ", "'s rocket"), ("lg", " accepts ", "'s shaft"), ("ssg", " ate 2 loads of ", "'s buckshot"), ("axe", " was ax-murdered by ", "")):
        line = line.when(F.col("weapon") == weapon, F.concat("victim", F.lit(phrase), "killer", F.lit(tail)))
    return f.select("match_id", "seq", X.obituary(line).alias("o")).select("match_id", "seq", "o.killer", "o.victim", "o.weapon", "o.is_suicide")


def server_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Lens(spark, sf_dir).table("orders")
    text = F.concat(F.lit("\\mode\\"), "o_orderstatus", F.lit("\\prio\\"), "o_orderpriority", F.lit("\\mode\\"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", F.explode(X.key_values(text)).alias("key", "value"))


def settings_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Lens(spark, sf_dir).table("orders")
    text = F.concat(F.lit("Countdown: 3\nMode   "), "o_orderpriority", F.lit("\nTimelimit  "), (F.col("o_custkey") % 30).cast("string"), F.lit("\nno matchtag\n"))
    return o.select("o_orderkey", F.explode(X.settings(text)).alias("key", "value"))


def settings_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countdown tables with names, numbers, switches and spawn models; one in four has no known key."""
    o = Lens(spark, sf_dir).table("orders")
    key = F.col("o_orderkey")
    model = F.get(F.array(*map(F.lit, ("QW", "K T X", "kt2", "none", "KTS"))), (key % 5).cast("int"))
    switch = F.get(F.array(*map(F.lit, ("on", "off", "1", "Yes", "true", ""))), (key % 6).cast("int"))
    full = F.concat(F.lit("Countdown: 3\n  Mode     D u e l\nRespawns   "), model, F.lit("\nTimelimit \t "), F.when(key % 3 == 0, F.lit("x")).otherwise((key % 30).cast("string")), F.lit("\nMidair  "), switch, F.lit("\nNoweapon  a   b\nno matchtag\n"))
    text = F.when(key % 4 == 0, F.lit("Countdown: 9\nOther thing\n")).otherwise(full)
    return o.select("o_orderkey", X.typed_settings(text).alias("s")).select("o_orderkey", F.col("s").isNotNull().alias("known"), "s.mode", "s.respawns", "s.spawn_k", "s.timelimit", "s.midair", "s.noweapon", "s.fraglimit")


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Lens(spark, sf_dir).table("lineitem")
    text = F.concat(F.lit("//took "), F.col("l_partkey").cast("string"), F.lit(" "), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise("x"), F.lit(" 7\n"))
    return li.select("l_orderkey", "l_linenumber", X.directive(text, "//took ", ("ent", "respawn", "player")).alias("d")).filter("d is not null").select("l_orderkey", "l_linenumber", "d.ent", "d.respawn", "d.player")


def message_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Lens(spark, sf_dir).messages
    marked = F.when(F.col("seq") == 1, F.concat(F.lit("The match has begun! "), "message")).when(F.col("seq") == 3, F.concat("message", F.lit(" the MATCH IS OVER"))).otherwise(F.col("message"))
    return K.match_bounds(m.select("match_id", (F.col("seq") * 1000).cast("int").alias("t_ms"), "seq", marked.alias("message")))


QUERIES = {f.__name__: f for f in (chat_lines, chat_distinct, chat_markup, normal_names, normal_text, obituaries, server_info, settings_tables, settings_typed, directives, message_bounds)}
ORACLES = {
    "chat_lines": "SELECT conv_id AS match_id, turn AS seq, CASE WHEN turn % 3 = 0 THEN 'teamsay' ELSE 'chat' END AS type, role AS player, sha256(text) AS text_sha FROM conversations WHERE turn % 3 < 2 AND NOT regexp_matches(text, ' joined the game| left the game| is ready|The match has|countdown')",
    "chat_distinct": "SELECT DISTINCT conv_id AS match_id, floor(turn / 2)::INT AS t_ms, 'chat' AS type, role AS player, text AS message FROM conversations",
    "chat_markup": r"SELECT conv_id AS match_id, turn AS seq, sha256(trim(regexp_replace(regexp_replace(text, '[{}\[\]]', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS clean_sha FROM conversations",
    "normal_names": "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS name FROM customer",
    "normal_text": "SELECT p_partkey, translate(p_name, 'eo', '0<') AS name FROM part",
    "obituaries": SQL + " SELECT match_id, seq, killer, victim, CASE WHEN is_suicide THEN 'suicide' ELSE weapon END AS weapon, is_suicide FROM frags",
    "server_info": "SELECT o_orderkey, 'prio' AS key, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'mode', o_custkey::VARCHAR FROM orders",
    "settings_tables": "SELECT o_orderkey, 'Mode' AS key, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'Timelimit', (o_custkey % 30)::VARCHAR FROM orders",
    "settings_typed": """SELECT o_orderkey, known, CASE WHEN known THEN 'Duel' END AS mode, CASE WHEN known THEN ['QW', 'KTX', 'kt2', 'none', 'KTS'][k % 5 + 1] END AS respawns, CASE WHEN known THEN [0, 3, 4, NULL, 1][k % 5 + 1] END::INT AS spawn_k,
CASE WHEN known THEN CASE WHEN k % 3 = 0 THEN 0 ELSE k % 30 END END::INT AS timelimit, CASE WHEN known THEN k % 6 IN (0, 2, 3, 4) END AS midair, CASE WHEN known THEN 'a b' END AS noweapon, NULL::INT AS fraglimit
FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 4 <> 0 AS known FROM orders)""",
    "directives": "SELECT l_orderkey, l_linenumber, l_partkey::INT AS ent, l_suppkey::INT AS respawn, 7 AS player FROM lineitem WHERE l_linenumber % 2 = 0",
    "message_bounds": "WITH m AS (SELECT DISTINCT conv_id AS match_id, turn FROM conversations), s AS (SELECT match_id FROM m WHERE turn = 1) SELECT match_id, 1000 AS start_ms, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.match_id = s.match_id AND turn = 3) THEN 3000 END AS end_ms FROM s",
}
