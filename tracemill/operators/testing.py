"""A pytest fixture for authors of workflows: run one by name and arguments, get its outputs as Arrow tables.

In a conftest.py:

    from tracemill.operators.testing import workflow_runner
    run_workflow = workflow_runner({"pack": [first, second]}, spark_fixture="spark")
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from . import workflow as wf


def workflow_runner(packs: Mapping[str, Sequence], spark_fixture: str = "spark"):
    """A fixture whose value is run(workflow=..., arguments=(), pack=...): outputs by name. A run that fails, fails the test."""

    @pytest.fixture
    def run_workflow(request, tmp_path) -> Callable[..., dict[str, pa.Table]]:
        store = wf.SessionStore(tmp_path / "sessions")
        host = wf.Host(request.getfixturevalue(spark_fixture), store, {k: list(v) for k, v in packs.items()})
        session = store.create()
        only = next(iter(packs)) if len(packs) == 1 else None

        def run(*, workflow: str, arguments: Sequence[str] = (), pack: str | None = only) -> dict[str, pa.Table]:
            if pack is None:
                raise TypeError("name the pack")
            known = {w.name: w for w in packs[pack]}
            try:
                done = host.run(session, pack, workflow, known[workflow].tokens(list(arguments)))
            except Exception as e:
                causes, at = [], e
                while at is not None:
                    causes.append(f"{type(at).__name__}: {at}")
                    at = at.__cause__
                pytest.fail("\n  caused by: ".join([f"workflow {workflow} failed", *causes]), pytrace=False)
            return {name: pq.read_table(path) for name, path in done.outputs.items()}

        yield run
        store.delete(session)

    return run_workflow
