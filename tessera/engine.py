"""A facade over the operators: tables under one path with a stored index, with add, search and lifecycle calls.

Every table lies in buckets of users. A manifest lists the folders of each bucket; it is written last, under the next
number and never over another, so a reader sees whole calls only and a second writer fails. An engine that is opened on
the path goes on from the last manifest. Adding appends messages and ledger and rewrites views, index and embeddings in
the buckets that it touches; deleting rewrites the users' buckets and then removes the files that held them.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import embed, ids
from tessera.operators import index, ingest, lifecycle, search, views
from tessera.operators.cut import materialize

DOCUMENT = "doc_id string, user_id string, doc_type string"
TABLES = {
    "messages": "id string, user_id string, session_id string, seq long, role string, content string, ts_ms long, created_at string, request_id string, added_at long",
    "ledger": "request_id string, user_id string, payload_hash string",
    "views": "view_id string, user_id string, session_id string, view_type string, content string, source_ids array<string>, start_seq long, end_seq long, ts_ms long, created_at string, content_hash string",
    "terms": f"{DOCUMENT}, dl long, terms array<string>",
    "postings": f"{DOCUMENT}, dl long, term string, tf long",
    "term_stats": "term string, df long",
    "corpus_stats": "n long, dl long",
    "embeddings": f"{DOCUMENT}, content_hash string, model_hash string, vector array<float>, dimension int",
    "sessions": "user_id string, session_id string, msg_count long, last_ts_ms long, seg_index long, seg_start long, seg_count long",
}
USERS = [n for n, s in TABLES.items() if "user_id" in s]
#: Buckets of users, fixed when a store is made; and folders of a bucket beyond which a call writes it anew as one.
BUCKETS, FOLDERS = 16, 8


class Engine:
    """One writer at a time; any number of readers, each of the version that it opened or refreshed."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, backend=None, buckets: int = BUCKETS):
        self.spark, self.path, self.config, self.backend = spark, path.rstrip("/"), (config or Config()).validate(), backend
        if self.config.on("vector") and backend is None:
            raise ValueError("the vector flag needs an embedding backend")
        self.manifest = {"version": 0, "buckets": buckets, "tables": {}}
        self.refresh()
        if self.config.on("vector") and self.manifest.get("model") not in (None, backend.model_hash):
            self._commit(self._embeddings(set(range(self.manifest["buckets"])), {}))

    # -- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def refresh(self) -> Engine:
        """Go on from the last whole manifest."""
        fs, folder = self._fs(f"{self.path}/_manifest")
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for name in names:
            text = "".join(r.value for r in self.spark.read.text(f"{self.path}/_manifest/{name}").collect())  # one short file
            try:
                self.manifest = json.loads(text)
                break
            except json.JSONDecodeError:  # cut off while it was written
                continue
        return self

    def _commit(self, tables: dict[str, dict[str, list[str]]], **more) -> None:
        """The next manifest with these tables; then the folders and manifests that no manifest lists are removed."""
        old = self.manifest
        model = {"model": self.backend.model_hash} if self.config.on("vector") else {}
        new = old | {"version": old["version"] + 1, "tables": old["tables"] | tables} | model | more
        fs, p = self._fs(f"{self.path}/_manifest/{new['version']:012d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self.manifest = new
        kept = {f for t in new["tables"].values() for folders in t.values() for f in folders}
        gone = [f for t in old["tables"].values() for folders in t.values() for f in folders if f not in kept]
        if old["version"]:
            gone.append(f"{self.path}/_manifest/{old['version']:012d}.json")
        for f in gone:
            fs, p = self._fs(f)
            fs.delete(p, True)

    def _bucket(self, user="user_id"):
        return F.pmod(F.xxhash64(F.col(user)), F.lit(self.manifest["buckets"])).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """rows written by bucket; the folder of each."""
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
        rows = rows if "bucket" in rows.columns else rows.withColumn("bucket", self._bucket())
        rows.select("bucket", *columns).write.partitionBy("bucket").parquet(folder)
        fs, p = self._fs(folder)
        made = [f.getPath().getName() for f in fs.listStatus(p)]
        return {m.removeprefix("bucket="): [f"{folder}/{m}"] for m in made if m.startswith("bucket=")}

    def _append(self, name: str, rows: DataFrame) -> dict[str, dict[str, list[str]]]:
        held, made = self.manifest["tables"].get(name, {}), self._write(name, rows)
        out = {b: held.get(b, []) + made.get(b, []) for b in {*held, *made}}
        full = {int(b) for b, folders in out.items() if len(folders) > FOLDERS}
        if full:
            merged = self._write(name, self._read(name, [f for b in full for f in out[str(b)]]).withColumn("bucket", self._bucket()))
            out |= {str(b): merged.get(str(b), []) for b in full}
        return {name: out}

    def _replace(self, name: str, rows: DataFrame, buckets: set[int]) -> dict[str, dict[str, list[str]]]:
        held, made = self.manifest["tables"].get(name, {}), self._write(name, rows)
        return {name: {b: f for b, f in held.items() if int(b) not in buckets} | made}

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or its rows in some buckets of users: no file of another bucket is listed or read. Columns that an older file lacks are null."""
        held = self.manifest["tables"].get(name, {})
        return self._read(name, [f for b, folders in held.items() if buckets is None or int(b) in buckets for f in folders])

    def _buckets_of(self, rows: DataFrame) -> set[int]:
        return {r.b for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # as many as there are buckets

    # -- writing

    def add(self, requests: DataFrame, now_ms: int | None = None) -> DataFrame:
        """Add a batch (request_id, user_id, session_id, messages, arrival); returns the verdict on each request. What was added is searchable when the call returns."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        requests = materialize(requests, "requests")
        touched = self._buckets_of(requests)
        judged = materialize(ingest.judge(requests, self.table("ledger", touched)), "judged")
        new = judged.where("verdict = 'new'")
        added = ingest.numbered(new, self.table("sessions", touched)).withColumn("added_at", F.lit(now))
        added = materialize(added.withColumn("created_at", ids.iso(F.coalesce("ts_ms", F.lit(now)))), "added")
        touched = self._buckets_of(added)
        if touched:
            made = self._append("messages", added) | self._append("ledger", new.select("request_id", "user_id", "payload_hash"))
            held = self._read("messages", [f for b in touched for f in made["messages"].get(str(b), [])])
            self._commit(made | self._derived(held, added.select("user_id", "session_id").distinct(), touched))
        return judged.select("request_id", "user_id", "session_id", "verdict")

    def _derived(self, messages: DataFrame, sessions: DataFrame | None, buckets: set[int]) -> dict[str, dict[str, list[str]]]:
        """Views, session cursors, index and embeddings of buckets, whose messages are given; only sessions' views are made anew, all if None."""
        out = {}
        if self.config.on("views"):
            made = views.all_views(messages, self.config) if sessions is None else views.refresh(self.table("views", buckets).drop("created_at"), sessions, messages, self.config)
            first = messages.select(F.col("id").alias("_first"), "created_at")
            out |= self._replace("views", made.withColumn("_first", F.element_at("source_ids", 1)).join(first, "_first", "left"), buckets)
        out |= self._replace("sessions", ingest.cursors(messages, self.config), buckets)
        docs = self._documents(messages, self._read("views", [f for b in buckets for f in out.get("views", {}).get(str(b), [])]))
        old = self.table("terms", buckets)
        known = old.join(docs.where("doc_type = 'message'").select("doc_id"), "doc_id", "left_semi")  # a message's text never changes
        terms = known.unionByName(index.indexed(docs.join(known.select("doc_id"), "doc_id", "left_anti")).select(old.columns))
        out |= self._replace("terms", terms, buckets)
        terms = self._read("terms", [f for b in buckets for f in out["terms"].get(str(b), [])]).withColumn("bucket", self._bucket())
        posts = index.postings(terms.drop("bucket"))
        out |= self._replace("postings", posts, buckets)
        posts = self._read("postings", [f for b in buckets for f in out["postings"].get(str(b), [])]).withColumn("bucket", self._bucket())
        out |= self._replace("term_stats", posts.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")), buckets)
        out |= self._replace("corpus_stats", terms.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")), buckets)
        if self.config.on("vector"):
            out |= self._embeddings(buckets, out, docs)
        return out

    def _embeddings(self, buckets: set[int], made: dict, docs: DataFrame | None = None) -> dict[str, dict[str, list[str]]]:
        """The embeddings of buckets after a refresh: missing and stale ones computed, orphans dropped."""
        docs = self.documents(buckets) if docs is None else docs
        return self._replace("embeddings", index.sync_embeddings(docs, self.table("embeddings", buckets), self.backend.model_hash, lambda c: embed.embed(c, self.backend)), buckets)

    def delete_users(self, users: DataFrame) -> DataFrame:
        """Delete users (user_id) everywhere, files included; table and deleted, a row a table."""
        users = materialize(users.select("user_id").distinct(), "users")
        buckets = self._buckets_of(users)
        report = self.spark.createDataFrame(lifecycle.deletion_report({n: self.table(n, buckets) for n in USERS}, users).collect(), "table string, deleted long")  # a row a table
        made: dict = {}
        for n in USERS:
            made |= self._replace(n, lifecycle.delete_users(self.table(n, buckets), users), buckets)
        own = lambda n: self._read(n, [f for b in buckets for f in made[n].get(str(b), [])]).withColumn("bucket", self._bucket())
        made |= self._replace("term_stats", own("postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")), buckets)
        made |= self._replace("corpus_stats", own("terms").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")), buckets)
        self._commit(made)
        return report

    def delete_user(self, user_id: str) -> DataFrame:
        return self.delete_users(self.spark.createDataFrame([(user_id,)], "user_id string"))

    def purge_stale(self, days: int | None = None, now_ms: int | None = None) -> None:
        """Delete the users whose last message was added more than days ago; 0 keeps everything."""
        days = self.config.retention_days if days is None else days
        if days > 0:
            now = int(time.time() * 1000) if now_ms is None else now_ms
            self.delete_users(lifecycle.stale_users(self.table("messages"), now - days * 86_400_000))

    def purge_all(self) -> None:
        self._commit({n: {} for n in TABLES})

    # -- reading

    def _documents(self, messages: DataFrame, stored: DataFrame) -> DataFrame:
        docs = messages.select(F.col("id").alias("doc_id"), "user_id", F.lit("message").alias("doc_type"), "session_id", "seq", "role", "content", "ts_ms", F.array("id").alias("source_ids"), "created_at")
        if self.config.on("views"):
            docs = docs.unionByName(stored.select(F.col("view_id").alias("doc_id"), "user_id", F.col("view_type").alias("doc_type"), "session_id", F.col("start_seq").alias("seq"), F.lit(None).cast("string").alias("role"), "content", "ts_ms", "source_ids", "created_at"))
        return docs

    def documents(self, buckets: set[int] | None = None) -> DataFrame:
        return self._documents(self.table("messages", buckets), self.table("views", buckets))

    def search(self, queries: DataFrame, **channels) -> DataFrame:
        """Search for the queries of any users. Documents and postings are those of the users' buckets; the statistics are of all."""
        queries = materialize(queries, "asked")
        buckets = self._buckets_of(queries)
        size = self.table("corpus_stats").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
        stored = index.Stored(self.table("terms", buckets), self.table("postings", buckets), self.table("term_stats"), size)
        if self.config.on("vector") and "query_vectors" not in channels:
            vectors = self.table("embeddings", buckets).where(F.col("model_hash") == self.backend.model_hash)
            channels |= {"query_vectors": queries.select("query_id", "user_id", embed.embed(F.col("query"), self.backend).alias("vector")), "vectors": vectors}
        return search.search(queries, self.documents(buckets), self.config, stored=stored, **channels)

    def count(self, user_id: str | None = None) -> int:
        return lifecycle.count(self.table("messages"), user_id)

    def stats(self) -> DataFrame:
        return lifecycle.stats(self.table("messages"), self.table("views"), self.table("ledger"), self.table("embeddings"))

    def sql(self, text: str, **args) -> DataFrame:
        """A query over the tables by name, as in SELECT .. FROM {messages}."""
        return self.spark.sql(text, args=args or None, **{n: self.table(n) for n in TABLES if "{" + n + "}" in text})

    def snapshot(self, path: str) -> Engine:
        """A copy of the tables under another path."""
        other = Engine(self.spark, path, self.config, self.backend, self.manifest["buckets"])
        made: dict = {}
        for n in USERS:
            made |= other._replace(n, self.table(n), set())
        own = lambda n: other._read(n, [f for folders in made[n].values() for f in folders]).withColumn("bucket", other._bucket())
        made |= other._replace("term_stats", own("postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")), set())
        made |= other._replace("corpus_stats", own("terms").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")), set())
        other._commit(made)
        return other
