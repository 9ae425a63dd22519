"""A labelled synthetic corpus, made in Spark from a seed: sessions of users, queries of several kinds with gold and distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids

#: users, sessions a user, messages a session
SCALES = {"smoke": (4, 3, 16), "small": (16, 3, 28), "medium": (48, 3, 36), "large": (120, 4, 40)}
TOPICS = ["budget", "deadline", "owner", "office", "vendor", "release", "quota", "library"]
PLACES = ["Lisbon", "Osaka", "Quito", "Turin", "Perth", "Oslo", "Dakar", "Lima"]
PEOPLE = ["Mira", "Jonas", "Ayla", "Pavel"]
DAYS = ["Monday", "Tuesday", "Thursday", "Friday"]
MEALS = ["rye bread", "eggs", "rice", "porridge"]
DRINKS = ["fruit", "yoghurt", "noodles", "toast"]
TOOLS = ["sieve", "probe", "scoop", "auger"]
FILLER = ["we talked about the weather", "the meeting ran long", "lunch was fine", "the printer broke again", "notes are in the folder"]


def _pick(values: list[str], *parts) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*parts), F.lit(len(values))) + 1).cast("int"))


def dataset(spark: SparkSession, scale: str = "smoke", seed: int = 1, difficulty: str = "plain", suite: str = "classic") -> tuple[DataFrame, DataFrame]:
    """(messages, queries). Per session one fact and, for odd sessions, a later update of it; queries ask for facts (single_hop), the present state (knowledge_update), or for what no one said (absent). Per user besides, what two sessions tell together (multi_session) and a habit that changed (temporal). The suite v11 adds a session a user with an update among remarks about it (governance_update_noise) and a preference among those of others (direct_preference). paraphrase difficulty asks without the fact's own verb, mixed asks every other user so."""
    if difficulty not in ("plain", "paraphrase", "mixed") or suite not in ("classic", "v11"):
        raise ValueError("difficulty is plain, paraphrase or mixed; suite is classic or v11")
    users, sessions, per = SCALES[scale]
    m = spark.range(users * sessions * per).select((F.col("id") / (sessions * per)).cast("int").alias("u"), ((F.col("id") / per) % sessions).cast("int").alias("s"), (F.col("id") % per).alias("seq"))
    s = F.lit(seed)
    project = F.concat(_pick(PLACES, s, "u", "s"), F.lit("-"), "u", F.lit("-"), "s")
    topic = _pick(TOPICS, s, "u", "s", F.lit(1))
    value = (F.pmod(F.xxhash64(s, "u", "s", F.lit(2)), F.lit(900)) + 100).cast("string")
    later = (F.pmod(F.xxhash64(s, "u", "s", F.lit(3)), F.lit(900)) + 1000).cast("string")
    m = m.withColumn("content", F.when(F.col("seq") == 3, F.concat(F.lit("the "), topic, F.lit(" of "), project, F.lit(" is "), value)).when((F.col("seq") == per - 2) & (F.col("s") % 2 == 1), F.concat(F.lit("the "), topic, F.lit(" of "), project, F.lit(" is now changed to "), later)).otherwise(F.concat(_pick(FILLER, s, "u", "s", "seq"), F.lit(" "), "seq")))
    rows = m.select(F.concat(F.lit("u"), "u").alias("user_id"), F.concat(F.lit("s"), "s").alias("session_id"), "seq", F.when(F.col("seq") % 2 == 0, "user").otherwise("assistant").alias("role"), "content", (F.lit(1_700_000_000_000) + F.col("u") * 1000 + F.col("s") * 86_400_000 + F.col("seq") * 60_000).alias("ts_ms"))
    rows = rows.withColumn("id", ids.message_id(F.col("user_id"), F.col("session_id"), F.col("seq")))
    q = spark.range(users * sessions).select((F.col("id") / sessions).cast("int").alias("u"), (F.col("id") % sessions).cast("int").alias("s"))
    user, sess = F.concat(F.lit("u"), "u"), F.concat(F.lit("s"), "s")
    at = lambda n: ids.message_id(user, sess, F.lit(n))
    kind = F.when(F.pmod(F.xxhash64(s, "u", "s", F.lit(4)), F.lit(5)) == 0, "absent").when(F.col("s") % 2 == 1, "knowledge_update").otherwise("single_hop")
    q = q.withColumn("kind", kind)
    easy = F.lit(difficulty == "plain") if difficulty != "mixed" else F.col("u") % 2 == 0
    either = lambda a, b: F.when(easy, F.lit(a)).otherwise(F.lit(b))
    text = F.when(F.col("kind") == "absent", F.lit("who won the chess game of Zagreb")).when(F.col("kind") == "knowledge_update", F.concat(either("what is the current ", "tell me the latest "), topic, F.lit(" of "), project)).otherwise(F.concat(either("what is the ", "say "), topic, either(" of ", " for "), project))
    none = F.array().cast("array<string>")
    gold = F.when(F.col("kind") == "absent", none).when(F.col("kind") == "knowledge_update", F.array(at(per - 2))).otherwise(F.array(at(3)))
    queries = q.select(F.concat_ws("-", user, sess).alias("query_id"), user.alias("user_id"), text.alias("query"), "kind", F.when(easy, "plain").otherwise("paraphrase").alias("difficulty"), gold.alias("gold"), F.when(F.col("kind") == "knowledge_update", F.array(at(3))).otherwise(none).alias("distractors"))
    extra, asked = _of_users(spark, scale, seed, suite, easy)
    key = ["user_id", "session_id", "seq"]
    own = extra.select(*key, "role", "content", "ts_ms").withColumn("id", ids.message_id(F.col("user_id"), F.col("session_id"), F.col("seq")))
    return rows.join(own, key, "left_anti").unionByName(own), queries.unionByName(asked)


def _of_users(spark: SparkSession, scale: str, seed: int, suite: str, easy) -> tuple[DataFrame, DataFrame]:
    """What is planted per user: (messages that take their places, queries)."""
    users, sessions, per = SCALES[scale]
    s, u, user = F.lit(seed), F.col("u"), F.concat(F.lit("u"), "u")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    hero, team = say(_pick(PEOPLE, s, "u"), "-", "u"), say(_pick(PLACES, s, "u", F.lit(8)), "-team-", "u")
    day, old, new = _pick(DAYS, s, "u"), _pick(MEALS, s, "u"), _pick(DRINKS, s, "u")
    tools = [say(_pick(TOOLS, s, "u"), "-", str(i)) for i in range(3)]
    was, now = (F.pmod(F.xxhash64(s, "u", F.lit(k)), F.lit(900)) + 100 * k for k in (20, 40))
    last = sessions - 1
    # session, place, role, text
    planted = [
        (0, 5, "user", say(hero, " now leads the ", team)), (min(1, last), 4, "user", say("the review of the ", team, " is every ", day)),
        (0, 8, "user", say(hero, " always has ", old, " for breakfast")), (last, per - 3, "user", say(hero, " switched to ", new, " for breakfast and no longer has ", old)),
    ]
    asked = [
        ("multi", "multi_session", F.when(easy, say("who leads the ", team, " and when is the review")).otherwise(say("who runs things at the ", team, " and when do they meet")), [(0, 5), (min(1, last), 4)], []),
        ("temporal", "temporal", F.when(easy, say("what does ", hero, " have for breakfast now")).otherwise(say("how did ", hero, " start the day lately")), [(last, per - 3)], [(0, 8)]),
    ]
    if suite == "v11":
        lines = [
            ("user", say("the funds of the ", team, " are ", was)), ("assistant", say("noted on the list")), ("user", say("the funds of the ", team, " are updated to ", now, " and ", was, " no longer holds")), ("assistant", say("I would suggest ", tools[0], " for sampling")),
            ("user", say("I prefer ", tools[1], " for sampling, it is my usual tool")), ("user", say(hero, " prefers ", tools[2], " for sampling")), ("user", say("the funds page of the ", team, " was updated to the new layout, values as before")), ("assistant", say("the page is filed")),
        ]
        planted += [(sessions, i, role, text) for i, (role, text) in enumerate(lines)]
        asked += [("noise", "governance_update_noise", say("what are the current funds of the ", team), [(sessions, 2)], [(sessions, 0), (sessions, 6)]), ("preference", "direct_preference", say("which tool do I prefer for sampling"), [(sessions, 4)], [(sessions, 3), (sessions, 5)])]
    who = spark.range(users).select(F.col("id").cast("int").alias("u"))
    m = who.select("u", user.alias("user_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).cast("long").alias("seq"), F.lit(r).alias("role"), t.alias("content")) for a, b, r, t in planted])).alias("p")).select("u", "user_id", "p.*")
    m = m.select("user_id", F.concat(F.lit("s"), "s").alias("session_id"), "seq", "role", "content", (F.lit(1_700_000_000_000) + F.col("u") * 1000 + F.col("s") * 86_400_000 + F.col("seq") * 60_000).alias("ts_ms"))
    at = lambda places: F.array(*[ids.message_id(user, F.lit(f"s{a}"), F.lit(b)) for a, b in places]).cast("array<string>")
    q = who.select("u", user.alias("user_id"), F.when(easy, "plain").otherwise("paraphrase").alias("difficulty"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), t.alias("query"), at(g).alias("gold"), at(d).alias("distractors")) for n, k, t, g, d in asked])).alias("a"))
    return m, q.select(F.concat_ws("-", "user_id", "a.name").alias("query_id"), "user_id", "a.query", "a.kind", "difficulty", "a.gold", "a.distractors")


def bulk_requests(messages: DataFrame, size: int = 20) -> DataFrame:
    """messages as add requests of at most size messages a session."""
    part = F.floor(F.col("seq") / size)
    rows = messages.groupBy("user_id", "session_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content", "ts_ms"))).alias("m"))
    one = lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["ts_ms"].alias("ts_ms"))
    return rows.select(F.concat_ws("-", "user_id", "session_id", "part").alias("request_id"), "user_id", "session_id", F.transform("m", one).alias("messages"), F.col("part").alias("arrival"))
