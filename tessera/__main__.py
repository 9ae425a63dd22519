"""Command line: python -m tessera --path STORE add | search | delete-user | purge | stats | selfcheck."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import SparkSession

from tessera.config import Config
from tessera.engine import Engine
from tessera.sources import tables

REQUEST = "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,ts_ms:bigint>>, arrival long"
QUERY = "query_id string, user_id string, query string, top_k int"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--path", required=True, help="folder of the store")
    p.add_argument("--config", help="JSON file of settings")
    verbs = p.add_subparsers(dest="verb", required=True)
    add = verbs.add_parser("add", help="add one message")
    for name in ("user", "request", "content"):
        add.add_argument(f"--{name}", required=True)
    add.add_argument("--session", default="cli-session")
    add.add_argument("--role", default="user")
    add.add_argument("--timestamp", type=int, help="Unix milliseconds")
    find = verbs.add_parser("search", help="search a user's messages")
    find.add_argument("--user", required=True)
    find.add_argument("--query", required=True)
    find.add_argument("--top-k", type=int, default=10)
    verbs.add_parser("delete-user", help="delete all of a user").add_argument("--user", required=True)
    verbs.add_parser("purge", help="delete everything").add_argument("--yes", action="store_true")
    verbs.add_parser("stats", help="counts without contents")
    verbs.add_parser("selfcheck", help="add, search, isolate, replay and delete under a user of its own")
    return p


def add(engine: Engine, request: str, user: str, session: str | None, role: str, content: str, timestamp: int | None = None) -> str:
    rows = engine.spark.createDataFrame([(request, user, session, [(role, content, timestamp)], 0)], REQUEST)
    return engine.add(rows).first().verdict


def find(engine: Engine, user: str, query: str, top_k: int) -> list[dict]:
    rows = engine.search(engine.spark.createDataFrame([("q", user, query, top_k)], QUERY))
    return [json.loads(r.value) for r in tables.evidence_json(rows).orderBy("position").collect()]  # top_k rows at most


def selfcheck(engine: Engine) -> list[tuple[str, bool]]:
    user, said = f"selfcheck-{uuid.uuid4().hex[:8]}", "order A7731 was sent on 2026-08-06"
    checks = [("a message is added", add(engine, "r1", user, "s", "user", said) == "new")]
    found = find(engine, user, "A7731", 10)
    checks.append(("it is found at once", any(said in (e.get("content") or "") for e in found)))
    checks.append(("another user finds nothing", find(engine, user + "-other", "A7731", 10) == []))
    checks.append(("a replay adds nothing", add(engine, "r1", user, "s", "user", said) == "replay" and engine.count(user) == 1))
    engine.delete_user(user)
    checks.append(("a deleted user finds nothing", find(engine, user, "A7731", 10) == [] and engine.count(user) == 0))
    return checks


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, args.path, Config.load(args.config))
    if args.verb == "add":
        verdict = add(engine, args.request, args.user, args.session, args.role, args.content, args.timestamp)
        print(json.dumps({"request_id": args.request, "verdict": verdict}))
        return 0 if verdict != "conflict" else 1
    if args.verb == "search":
        print(json.dumps(find(engine, args.user, args.query, args.top_k), ensure_ascii=False))
    elif args.verb == "delete-user":
        print(json.dumps({r["table"]: r.deleted for r in engine.delete_user(args.user).collect()}))
    elif args.verb == "purge":
        if not args.yes:
            print("purge deletes everything: give --yes", file=sys.stderr)
            return 2
        engine.purge_all()
    elif args.verb == "stats":
        print(json.dumps(engine.stats().first().asDict()))
    else:
        checks = selfcheck(engine)
        for name, passed in checks:
            print("PASS" if passed else "FAIL", name)
        return 0 if all(passed for _, passed in checks) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
