"""Queries take whole texts and whole tables."""

import os

import duckdb
import pytest

from shotlake.plans import more, oracles, queries

QUERIES, ORACLES = queries.QUERIES | more.QUERIES, oracles.ORACLES | more.ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", ["g9_list", "g9_synthesize", "g9_concat", "g13_summary", "g13_comparison"])
def test_answers_are_whole(spark, sf_dir, name):
    by: dict[int, list] = {}
    for job, turn, text in duckdb.sql(f"SELECT conv_id, turn, text FROM '{sf_dir}/conversations.parquet' ORDER BY ALL").fetchall():
        by.setdefault(job, []).append((turn, text))
    assert any(len(x) > 300 for own in by.values() for _, x in own)
    label = lambda s: f"{s // 60:02d}:{s % 60:02d}"
    forms = {
        "g9_list": lambda own: "\n".join(f"[{label(s)}] {x}" for s, x in own),
        "g9_synthesize": lambda own: own[0][1] if len(own) == 1 else " ".join(f"{'At the beginning (' if i == 0 else 'Finally (' if i == len(own) - 1 else 'At '}{label(s)}{')' if i in (0, len(own) - 1) else ''}: {x}" for i, (s, x) in enumerate(own)),
        "g9_concat": lambda own: " ".join(x for _, x in own),
        "g13_summary": lambda own: "\n".join(["Summarise these observations:", *(f"{i + 1}. [{label(s)}.000] {x}" for i, (s, x) in enumerate(own))]),
        "g13_comparison": lambda own: "\n".join(["Compare with regard to: mood", *(f"Item {i + 1}: {x}" for i, (_, x) in enumerate(own))]),
    }
    column = "answer" if name.startswith("g9") else "prompt"
    got = {r["job_id"]: r[column] for r in QUERIES[name](spark, sf_dir).select("job_id", column).collect()}
    assert got == {job: forms[name](own) for job, own in by.items()}


def test_selected_frames_are_typed(spark, duck, sf_dir):
    selected = {r[:2] for r in duck.sql(f"SELECT job_id, frame_index FROM ({ORACLES['g6_select']})").fetchall()}
    flags = {r[:2]: r[2] for r in duck.sql(f"SELECT job_id, frame_index, is_boundary FROM ({ORACLES['j3_boundary_flag']})").fetchall()}
    got = [(r["job_id"], r["frame_index"], r["frame_type"]) for r in QUERIES["g7_frame_rows"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((*k, "scene_boundary" if flags[k] else "regular") for k in selected)


def test_jobs_are_ready_by_their_state(spark, duck, sf_dir):
    ready = sorted({r[0] for r in duck.sql(f"WITH RECURSIVE {oracles.FOLD} SELECT job_id FROM fin WHERE status = 'complete'").fetchall()})
    sql = ORACLES["g14_query_path"].replace("job_id % 2 = 0", f"job_id IN ({', '.join(map(str, [-1, *ready]))})")
    got = [(r["frame_index"], round(r["score"], 6)) for r in QUERIES["g14_query_path"](spark, sf_dir).collect()]
    want = duck.sql(f"SELECT frame_index, round(score, 6) FROM ({sql})").fetchall()
    assert ready and sorted(got) == sorted(want)


def test_all_documents_are_merged(spark, duck, sf_dir):
    want = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    want |= {r[0]: "patched" for r in duck.sql("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    rows = QUERIES["k10_field_merge"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {r["doc_id"]: r["source"] for r in rows} == want
