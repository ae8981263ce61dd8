"""Paid calls: once per prompt, also when a task dies, and no more at a time than permits."""

from __future__ import annotations

import pytest

from callweave.plans import summaries


def _service(folder, deadly=None):
    """Answers each prompt and notes the call; the deadly prompt ends the worker once it has let the others finish."""

    def factory():
        import asyncio
        import os
        import pathlib
        import time
        import uuid

        async def answer(prompt):
            if prompt == deadly:
                await asyncio.sleep(1.5)
                os._exit(1)
            begun = time.time()
            await asyncio.sleep(0.1)
            (pathlib.Path(folder) / uuid.uuid4().hex).write_text(f"{prompt}\n{begun}\n{time.time()}")
            return f"about {prompt}"

        return answer

    return factory


def test_a_dead_task_repeats_no_call(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(f"p{i % 20}",) for i in range(40)] + [("deadly",), (None,)], "prompt string").coalesce(1)
    log = str(tmp_path / "answers")
    with pytest.raises(Exception, match="Python worker|crashed|EOF"):
        summaries.generated(rows, "prompt", _service(str(tmp_path / "calls"), "deadly"), "answer", 64, log=log).collect()
    assert len(list((tmp_path / "calls").iterdir())) > 0
    got = summaries.generated(rows, "prompt", _service(str(tmp_path / "calls")), "answer", 64, log=log).collect()
    assert {r.answer for r in got if r.prompt is None} == {None}
    assert all(r.answer == f"about {r.prompt}" for r in got if r.prompt is not None) and len(got) == 42
    called = [p.read_text().split("\n")[0] for p in (tmp_path / "calls").iterdir()]
    again = summaries.generated(rows, "prompt", _service(str(tmp_path / "calls")), "answer", 64, log=log).collect()
    assert len(again) == 42 and len(list((tmp_path / "calls").iterdir())) == len(called)
    assert sorted(called) == sorted([f"p{i}" for i in range(20)] + ["deadly"])


def test_permits_hold_for_the_whole_job(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}",) for i in range(60)], "prompt string").repartition(12)
    summaries.generated(rows, "prompt", _service(str(tmp_path)), "answer", 3).collect()
    spans = [tuple(map(float, p.read_text().split("\n")[1:])) for p in tmp_path.iterdir()]
    assert len(spans) == 60
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 3
