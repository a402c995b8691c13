"""Stateful streams over several micro-batches, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from caseframe.streaming import edits, lookups

T0 = datetime(2024, 1, 1)


def folder_stream(spark, path, schema: str, batches: list[list[tuple]]):
    """A stream that reads one file, that is one list of rows, in each micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return edits.submissions(spark, f"{path}/*", schema, files_each=1)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def test_a_case_comes_anew_with_each_reply(spark, tmp_path):
    cases = folder_stream(spark, f"{tmp_path}/cases", "case_id string, at timestamp, items array<string>", [[("a", at(0), ["x", "y", "x"]), ("b", at(0), [])], [("c", at(2), ["z"])], [("a", at(4), ["x", "y", "w"])], [("far", at(500), ["q"])]])
    replies = folder_stream(spark, f"{tmp_path}/replies", "case_id string, at timestamp, item string, answer string", [[("c", at(1), "z", "early"), ("a", at(1), "other", "1")], [("a", at(3), "x", "2"), ("a", at(2.5), "x", "older")], [("a", at(3), "x", "2")], [("far", at(501), "q", "1")]])
    out = edits.run_to_folder(lookups.cases_with_replies(cases, replies, 60), f"{tmp_path}/out").collect()
    rows = {(r.case_id, r.version, r.state): (r.at, {k.item: k.answer for k in r.known}, r.missing) for r in out}
    assert rows["a", 1, "open"] == (at(1), {}, ["x", "y"]) and rows["b", 1, "complete"] == (at(0), {}, [])
    assert rows["a", 2, "open"] == (at(3), {"x": "2"}, ["y"]) and rows["c", 1, "complete"] == (at(2), {"z": "early"}, [])
    assert rows["a", 3, "open"] == (at(4), {"x": "2"}, ["y", "w"]) and rows["far", 1, "complete"][1] == {"q": "1"}
    assert {k[:1] + k[2:] for k in rows if k[2] == "closed"} <= {("a", "closed"), ("b", "closed"), ("c", "closed")}
    assert ("a", 3, "closed") in rows and len(rows) == len(out)


def test_replies_without_a_case_are_forgotten(spark, tmp_path):
    cases = folder_stream(spark, f"{tmp_path}/cases", "case_id string, at timestamp, items array<string>", [[("k", at(0), ["x"])], [("k", at(900), ["x"])], [("late", at(901), ["x"])]])
    replies = folder_stream(spark, f"{tmp_path}/replies", "case_id string, at timestamp, item string, answer string", [[("late", at(0), "x", "1")], [], []])
    out = edits.run_to_folder(lookups.cases_with_replies(cases, replies, 60), f"{tmp_path}/out").collect()
    assert [(r.state, r.missing) for r in out if r.case_id == "late"] == [("open", ["x"])]


def decided(batches: list[list[tuple]], minutes: int, most: int) -> list[tuple]:
    """Requests in order, one cache for each task."""
    caches: dict[str, dict[str, datetime]] = {}
    out = []
    for rows in batches:
        for task, url, when in sorted(rows, key=lambda r: (r[2], r[1])):
            pages = caches.setdefault(task, {})
            fetch = not (url in pages and when - pages[url] <= timedelta(minutes=minutes))
            if fetch:
                if url not in pages and len(pages) >= most:
                    pages.clear()
                pages[url] = when
            out.append((task, url, when, fetch))
    return sorted(out)


def test_pages_are_fetched_once_in_a_while(spark, tmp_path):
    draw = random.Random(4)
    batches, now = [], 0.0
    for _ in range(6):
        rows = []
        for _ in range(40):
            now += draw.choice([0.1, 0.5, 1])
            rows.append((draw.choice("st"), draw.choice("abcdefg"), at(round(now, 2))))
        batches.append(rows)
    stream = folder_stream(spark, f"{tmp_path}/in", "task string, url string, at timestamp", batches)
    out = edits.run_to_folder(lookups.fetch_or_cached(stream, minutes=5, most=4), f"{tmp_path}/out").collect()
    assert sorted((r.task, r.url, r.at, r.fetch) for r in out) == decided(batches, 5, 4)


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    stream = folder_stream(spark, f"{tmp_path}/in", "task string, url string, at timestamp", [[]])
    assert edits.run_to_folder(lookups.fetch_or_cached(stream), f"{tmp_path}/out").count() == 0


def test_many_cases_are_evaluated_in_one_call(spark, tmp_path):
    """Cases of one bucket are each given as if alone, and take one call of the function for all."""
    draw, kinds = random.Random(9), ("case_id string, at timestamp, items array<string>", "case_id string, at timestamp, item string, answer string")
    cases = [[(f"c{i}", at(200 * b + draw.random()), draw.sample("wxyz", 2)) for i in range(40) if draw.random() < 0.5] for b in range(4)]
    replies = [[(f"c{draw.randrange(44)}", at(200 * b + draw.random()), draw.choice("wxyz"), str(draw.random())) for _ in range(60)] for b in range(4)]
    results = []
    for buckets in (1, 512):
        path = f"{tmp_path}/{buckets}"
        stream = lookups.cases_with_replies(folder_stream(spark, f"{path}/cases", kinds[0], cases), folder_stream(spark, f"{path}/replies", kinds[1], replies), 60, buckets)
        out = edits.run_to_folder(stream, f"{path}/out").collect()
        results.append(sorted((r.case_id, r.at, r.version, r.state, [tuple(k) for k in r.known], r.missing) for r in out))
    assert results[0] == results[1] and {r[3] for r in results[0]} == {"open", "complete", "closed"}
