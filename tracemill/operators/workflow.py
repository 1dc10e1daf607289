"""Typed workflows, nested runs, and the store of sessions and published runs."""

from __future__ import annotations

import fcntl
import inspect
import json
import math
import os
import re
import shutil
import threading
import time
import tomllib
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from types import NoneType, UnionType
from typing import Literal, Union, get_args, get_origin, get_type_hints

from pyspark.sql import SparkSession

from ..functions import types as ty
from ..sources.catalog import Catalog, open_catalog
from .outputs import materialise, publish

WORKFLOW_NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


@dataclass(frozen=True)
class Input:
    name: str
    kind: object
    choices: tuple[str, ...]
    nullable: bool
    required: bool
    default: object

    def check(self, value: object) -> object:
        if value is None and self.nullable:
            return None
        if self.choices:
            if type(value) is str and value in self.choices:
                return value
        elif type(value) is self.kind and not (self.kind is int and value not in ty.INT64) and not (self.kind is float and not math.isfinite(value)):
            return value
        raise ty.AdmissionError(f"input {self.name}: {value!r} is not admitted")

    def parse(self, text: str) -> object:
        """The value of a command-line token."""
        if self.choices or self.kind is str:
            return self.check(text)
        if self.kind is int and re.fullmatch(r"[+-]?[0-9]+", text):
            return self.check(int(text))
        if self.kind is float:
            try:
                return self.check(float(text))
            except ValueError as e:
                raise ty.AdmissionError(f"input {self.name}: {text!r} is no number") from e
        if self.kind in (ty.Duration, ty.WallClockTimestamp):
            return self.kind.parse(text)
        raise ty.AdmissionError(f"input {self.name}: {text!r} is not admitted")


@dataclass(frozen=True)
class Workflow:
    name: str
    description: str
    guide: str | None
    function: Callable
    inputs: tuple[Input, ...]

    def arguments(self, given: Mapping[str, object]) -> dict[str, object]:
        known = {i.name: i for i in self.inputs}
        if extra := set(given) - set(known):
            raise ty.AdmissionError(f"{self.name}: unknown inputs {sorted(extra)}")
        out = {}
        for name, i in known.items():
            if name in given:
                out[name] = i.check(given[name])
            elif i.required:
                raise ty.AdmissionError(f"{self.name}: input {name} is missing")
            else:
                out[name] = i.default
        return out

    def tokens(self, argv: list[str]) -> dict[str, object]:
        """Inputs from --kebab-case tokens; booleans are --name and --no-name."""
        known = {i.name.replace("_", "-"): i for i in self.inputs}
        out: dict[str, object] = {}
        rest = list(argv)
        while rest:
            word, _, value = rest.pop(0).partition("=")
            key = word.removeprefix("--")
            plain = known.get(key) or known.get(key.removeprefix("no-"))
            if not word.startswith("--") or plain is None or plain.name in out:
                raise ty.AdmissionError(f"{self.name}: unexpected {word!r}")
            if plain.kind is bool:
                out[plain.name] = key in known
            else:
                if not value and not rest:
                    raise ty.AdmissionError(f"{self.name}: {word} needs a value")
                out[plain.name] = plain.parse(value or rest.pop(0))
        return self.arguments(out)


def _input(p: inspect.Parameter, kind: object) -> Input:
    nullable, choices = False, ()
    if get_origin(kind) in (Union, UnionType):
        rest = [a for a in get_args(kind) if a is not NoneType]
        if len(rest) != 1 or len(get_args(kind)) != 2:
            raise ty.AdmissionError(f"input {p.name}: unsupported type {kind!r}")
        kind, nullable = rest[0], True
    if get_origin(kind) is Literal:
        choices = get_args(kind)
        if not all(type(c) is str for c in choices):
            raise ty.AdmissionError(f"input {p.name}: only texts may be choices")
        kind = str
    if kind not in (str, int, float, bool, ty.Duration, ty.WallClockTimestamp):
        raise ty.AdmissionError(f"input {p.name}: unsupported type {kind!r}")
    required = p.default is inspect.Parameter.empty
    if kind is bool and (required or nullable):
        raise ty.AdmissionError(f"input {p.name}: a boolean needs a default")
    if nullable and (required or p.default is not None):
        raise ty.AdmissionError(f"input {p.name}: the default of an optional input is None")
    out = Input(p.name, kind, choices, nullable, required, None if required else p.default)
    if not required:
        out.check(p.default)
    return out


def workflow(*, name: str, description: str, guide: str | None = None) -> Callable[[Callable], Workflow]:
    """Declares a top-level function whose first parameter is `ctx: Context` as a workflow; the others are its typed inputs."""
    if not WORKFLOW_NAME.fullmatch(name) or not description.strip():
        raise ty.AdmissionError(f"invalid workflow name or description: {name!r}")

    def wrap(function: Callable) -> Workflow:
        if inspect.iscoroutinefunction(function) or inspect.isgeneratorfunction(function):
            raise ty.AdmissionError(f"{name}: a workflow is a plain function")
        hints = get_type_hints(function, {**function.__globals__, **inspect.getclosurevars(function).nonlocals})
        first, *rest = inspect.signature(function).parameters.values()
        if first.name != "ctx" or hints.get("ctx") is not Context:
            raise ty.AdmissionError(f"{name}: the first parameter must be ctx: Context")
        return Workflow(name, description, guide, function, tuple(_input(p, hints.get(p.name)) for p in rest))

    return wrap


@dataclass(frozen=True)
class Provider:
    name: str
    description: str
    guide: str | None
    cls: type


def provider(*, name: str, description: str, guide: str | None = None) -> Callable[[type], type]:
    """Attaches metadata to a provider class."""

    def wrap(cls: type) -> type:
        cls.__provider__ = Provider(name, description, guide, cls)
        return cls

    return wrap


def uuid7() -> uuid.UUID:
    ms = time.time_ns() // 1_000_000
    value = (ms << 80) | int.from_bytes(os.urandom(10), "big")
    return uuid.UUID(int=(value & ~(0xF << 76) & ~(0x3 << 62)) | (0x7 << 76) | (0x2 << 62))


class SessionStore:
    """Folders of sessions; a session is leased while it is open and can be deleted only when it is not."""

    def __init__(self, root: Path):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def create(self) -> str:
        sid = str(uuid7())
        for d in ("materializations", "scratch", "runs"):
            (self.root / sid / d).mkdir(parents=True)
        (self.root / sid / "lease").touch()
        return sid

    def path(self, sid: str) -> Path:
        if str(uuid.UUID(sid)) != sid or not (self.root / sid).is_dir():
            raise KeyError(f"no session {sid}")
        return self.root / sid

    def lease(self, sid: str):
        """An open file with a shared lock; closing it ends the lease."""
        f = (self.path(sid) / "lease").open()
        fcntl.flock(f, fcntl.LOCK_SH)
        return f

    def delete(self, sid: str) -> None:
        at = self.path(sid)
        with (at / "lease").open() as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError as e:
                raise RuntimeError(f"session {sid} is in use") from e
            gone = at.with_name(f".deleted-{sid}")
            at.rename(gone)
        shutil.rmtree(gone)

    def manifest(self, sid: str, run: str) -> dict:
        return json.loads((self.path(sid) / "runs" / run / "manifest.json").read_text("utf-8"))


@dataclass(frozen=True)
class Run:
    session_id: str
    run_id: str
    outputs: dict[str, Path]
    manifest: dict

    def catalog(self) -> Catalog:
        return open_catalog(tables=self.outputs)


@dataclass
class Context:
    """What a workflow may use while it runs, and not after."""

    spark: SparkSession
    _host: Host
    _session: str
    _chain: tuple[tuple[str, str], ...]
    _scratch: Path
    _children: list[str] = field(default_factory=list)
    _open: bool = True
    _active: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def run(self, pack: str, name: str, **inputs: object) -> Catalog:
        """Publishes a run of another workflow and returns its outputs."""
        with self._lock:
            if not self._open:
                raise RuntimeError("the workflow has returned")
            self._active += 1
        try:
            done = self._host._run(self._session, pack, name, inputs, self._chain)
            with self._lock:
                self._children.append(done.run_id)
            return done.catalog()
        finally:
            with self._lock:
                self._active -= 1

    @property
    def scratch_root(self) -> Path:
        if not self._open:
            raise RuntimeError("the workflow has returned")
        return self._scratch

    @property
    def datasource_root(self) -> Path:
        if not self._open:
            raise RuntimeError("the workflow has returned")
        return self._host.store.path(self._session) / "materializations"


class Host:
    """Runs workflows of packs; the manifest, written last, is what makes a run a published one."""

    def __init__(self, spark: SparkSession, store: SessionStore, packs: Mapping[str, list[Workflow]]):
        self.spark, self.store = spark, store
        self.packs = {p: {w.name: w for w in ws} for p, ws in packs.items()}

    def run(self, session: str, pack: str, name: str, inputs: Mapping[str, object]) -> Run:
        with self.store.lease(session):
            return self._run(session, pack, name, inputs, ())

    def _run(self, session: str, pack: str, name: str, inputs: Mapping[str, object], chain: tuple) -> Run:
        if (pack, name) in chain:
            raise RecursionError(f"{pack}/{name} is running already: {chain}")
        if name not in self.packs.get(pack, {}):
            raise KeyError(f"no workflow {pack}/{name}")
        w = self.packs[pack][name]
        args = w.arguments(inputs)
        at = self.store.path(session)
        run_id = str(uuid7())
        scratch = at / "scratch" / run_id
        staging = at / "runs" / f".{run_id}"
        scratch.mkdir()
        staging.mkdir()
        ctx = Context(self.spark, self, session, (*chain, (pack, name)), scratch)
        try:
            result = w.function(ctx, **args)
            with ctx._lock:
                ctx._open = False
                if ctx._active:
                    raise RuntimeError(f"{name} returned while {ctx._active} nested runs were active")
            outputs = materialise(result, staging / "outputs")
            manifest = {
                "session_id": session, "run_id": run_id, "pack": pack, "workflow": name, "guide": w.guide, "child_runs": ctx._children,
                "inputs": {k: projected(v) for k, v in args.items()}, "outputs": sorted(outputs),
            }
            with (staging / "manifest.json").open("x", encoding="utf-8") as f:
                json.dump(manifest, f)
                f.flush()
                os.fsync(f.fileno())
            publish(staging, at / "runs" / run_id)
        finally:
            ctx._open = False
            shutil.rmtree(scratch, ignore_errors=True)
            shutil.rmtree(staging, ignore_errors=True)
        top = at / "runs" / run_id / "outputs"
        return Run(session, run_id, {n: top / f"{n}.parquet" for n in outputs}, manifest)


def projected(value: object) -> object:
    """An input as the manifest shows it: integers as decimal text, spans and instants as text."""
    if type(value) is int:
        return str(value)
    return str(value) if isinstance(value, (ty.Duration, ty.WallClockTimestamp)) else value


def discover(*roots: str | Path) -> dict[str, Path]:
    """Packs below the roots by name; a pack.toml has exactly name, title, description and owner; equal names fail everything."""
    out: dict[str, Path] = {}
    for root in map(Path, roots):
        for toml in sorted(root.glob("*/pack.toml")):
            data = tomllib.loads(toml.read_text("utf-8"))
            if set(data) != {"name", "title", "description", "owner"} or not all(isinstance(v, str) and v.strip() for v in data.values()):
                raise ty.AdmissionError(f"{toml}: needs exactly name, title, description and owner")
            if not WORKFLOW_NAME.fullmatch(data["name"]):
                raise ty.AdmissionError(f"{toml}: invalid name")
            if data["name"] in out:
                raise ty.AdmissionError(f"pack {data['name']} is there twice: {out[data['name']]} and {toml.parent}")
            out[data["name"]] = toml.parent
    return out


class AnalysisRecord:
    """A JSON document with a revision; a save names the revision it is based on."""

    VERSION = 3

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def show(self) -> dict:
        if not self.path.exists():
            return {"schema_version": self.VERSION, "revision": 0, "goal": None, "nodes": [], "materials": [], "report": None}
        return json.loads(self.path.read_text("utf-8"))

    def save(self, based_on: int, **changes: object) -> dict:
        with self.path.with_suffix(".lock").open("w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            now = self.show()
            if now["revision"] != based_on:
                raise RuntimeError(f"revision {based_on} is not the latest, {now['revision']}")
            if extra := set(changes) - {"goal", "nodes", "materials", "report"}:
                raise ty.AdmissionError(f"unknown fields {sorted(extra)}")
            out = now | changes | {"revision": based_on + 1}
            fresh = self.path.with_suffix(".new")
            fresh.write_text(json.dumps(out), "utf-8")
            os.replace(fresh, self.path)
            return out


def forest(nodes: list[str], edges: Mapping[str, list[str]]) -> list[dict]:
    """Trees over the selected runs by parent to child edges; several parents and cycles are errors."""
    chosen = set(nodes)
    parent: dict[str, str] = {}
    for p in nodes:
        for c in edges.get(p, ()):
            if c in chosen:
                if c in parent:
                    raise ty.AdmissionError(f"run {c} has the parents {parent[c]} and {p}")
                parent[c] = p
    for n in nodes:
        at, steps = n, 0
        while at in parent:
            at, steps = parent[at], steps + 1
            if steps > len(nodes):
                raise ty.AdmissionError(f"runs form a cycle at {n}")

    def tree(n: str) -> dict:
        return {"run": n, "children": [tree(c) for c in edges.get(n, ()) if parent.get(c) == n]}

    return [tree(n) for n in nodes if n not in parent]
