"""Lookups that run beside the cases: replies that come late and are joined to their case, requests answered from a cache.

Both keep state by key with event-time timers, so that they restart from their checkpoint and forget what is over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_EVENTS = "case_id string, at timestamp, items array<string>, item string, answer string"
EVALUATED = "case_id string, version int, at timestamp, known array<struct<item:string,answer:string>>, missing array<string>, state string"
#: Minutes for which a page fetched stays good, and pages remembered of a task; beyond these it forgets them all.
KEEP_MINUTES, MOST_KEPT = 10, 500
#: Buckets of cases that are evaluated together.
BUCKETS = 1024


def cases_with_replies(cases: DataFrame, replies: DataFrame, minutes: int, buckets: int = BUCKETS) -> DataFrame:
    """A case anew whenever a reply to one of its lookups comes: version from 1, the replies known so far, the lookups still missing.

    cases: case_id, at, items (what is looked up; a later row replaces an earlier one); replies: case_id, at, item, answer (the latest by `at`,
    then the largest, counts; those that come before their case wait for it, those to what the case doesn't ask are kept out). state is
    open, complete, or closed: `minutes` of event time after the last event a case is given once more and forgotten; replies whose case
    never came are forgotten without a row. One row for each case and micro-batch in which something changed.

    Cases are dealt into `buckets` that share a state and a timer, since a call for each case costs far more than its work; a bucket's
    state is written anew when one of its cases changes. Give more buckets for many more cases; a checkpoint keeps to its number."""
    schema = [c.split()[0] for c in _EVENTS.split(", ")]
    asked = cases.select(F.col("case_id").cast("string").alias("case_id"), "at", F.col("items").cast("array<string>").alias("items"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("answer"))
    said = replies.select(F.col("case_id").cast("string").alias("case_id"), "at", F.lit(None).cast("array<string>").alias("items"), F.col("item").cast("string").alias("item"), F.col("answer").cast("string").alias("answer"))
    events = asked.unionByName(said).select(schema).withWatermark("at", f"{minutes} minutes")
    wait = minutes * 60_000

    def evaluate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str | None, dict] = dict(json.loads(state.get[0])) if state.exists else {}
        now, rows, came = state.getCurrentWatermarkMs(), [], {}
        for frame in () if state.hasTimedOut else frames:
            times = frame["at"].to_numpy("datetime64[ms]").astype("int64").tolist()
            for case_id, ms, items, item, answer in zip(frame["case_id"], times, frame["items"], frame["item"], frame["answer"], strict=True):
                if case_id not in came:
                    case = held.get(case_id)
                    if case is not None and case["last"] + wait <= now:  # events in the batch that ends its time come too late
                        if case["items"] is not None:
                            rows.append(_row(case_id, case, "closed"))
                        case = None
                    if case is None:
                        case = held[case_id] = {"items": None, "asked": 0, "answers": {}, "version": 0, "last": 0}
                    came[case_id] = case["items"], dict(case["answers"])
                case = held[case_id]
                case["last"] = max(case["last"], ms)
                if items is not None:
                    if case["items"] is None or ms >= case["asked"]:
                        case["items"], case["asked"] = list(dict.fromkeys(items)), ms
                elif item is not None:
                    case["answers"][item] = max(case["answers"].get(item, [0, ""]), [ms, answer or ""])
        for case_id, before in came.items():
            case = held[case_id]
            case["until"] = max(case["last"] + wait, now + 1)
            if (case["items"], case["answers"]) != before and case["items"] is not None:
                case["version"] += 1
                rows.append(_row(case_id, case, "complete" if all(i in case["answers"] for i in case["items"]) else "open"))
        for case_id in [c for c, case in held.items() if case["until"] < now]:
            case = held.pop(case_id)
            if case["items"] is not None:
                rows.append(_row(case_id, case, "closed"))
        if held:
            state.update((json.dumps(list(held.items())),))
            state.setTimeoutTimestamp(max(min(case["until"] for case in held.values()), now + 1))
        elif state.exists:
            state.remove()
        for at in range(0, len(rows), 10_000):
            out = pd.DataFrame(rows[at : at + 10_000], columns=["case_id", "version", "at", "known", "missing", "state"])
            yield out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(evaluate, EVALUATED, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def _row(case_id: str | None, held: dict, state: str) -> tuple:
    known = [{"item": i, "answer": held["answers"][i][1]} for i in held["items"] if i in held["answers"]]
    missing = [i for i in held["items"] if i not in held["answers"]]
    return case_id, held["version"], held["last"], known, missing, state


def fetch_or_cached(requests: DataFrame, minutes: int = KEEP_MINUTES, most: int = MOST_KEPT) -> DataFrame:
    """task, url, at and fetch of every request: whether the page has to be fetched, or was fetched for the same task at most `minutes` ago.

    requests: task, url, at. A fetch that would be the task's page number most + 1 makes it forget the others first, so that state is
    bounded. Requests of a micro-batch are taken in the order of `at` and url; a task that is silent for `minutes` is forgotten."""
    keep = minutes * 60_000
    events = requests.select("task", "url", "at").where("task IS NOT NULL AND url IS NOT NULL AND at IS NOT NULL").withWatermark("at", f"{minutes} minutes")

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pages: dict[str, int] = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["at", "url"], kind="stable")
        fetch, last = [], 0
        for url, at in zip(rows["url"], rows["at"], strict=True):
            ms = int(at.timestamp() * 1000)
            last = max(last, ms)
            fresh = url in pages and ms - pages[url] <= keep
            if not fresh:
                if url not in pages and len(pages) >= most:
                    pages.clear()
                pages[url] = ms
            fetch.append(not fresh)
        state.update((json.dumps(pages),))
        state.setTimeoutTimestamp(max(max(last, *pages.values()) + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task": key[0], "url": rows["url"].to_numpy(), "at": rows["at"].to_numpy(), "fetch": fetch})

    return events.groupBy("task").applyInPandasWithState(decide, "task string, url string, at timestamp, fetch boolean", "pages string", "append", GroupStateTimeout.EventTimeTimeout)
