"""Graphs of nodes: checked when they are wired, run as one lazy plan."""

from __future__ import annotations

import hashlib
import json
from collections import deque
from dataclasses import dataclass, field, replace

from rasterloom.frame import IMAGE, Rel
from rasterloom.operators import combine, detail, geometry, masks, point, select, spatial  # noqa: F401  they register their nodes
from rasterloom.operators.node import REGISTRY, EngineError, run

SOURCES = ("image_source", "file", "catalog")


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    label: str = ""


@dataclass(frozen=True)
class Wire:
    from_id: str
    to_id: str
    to_port: str


@dataclass
class Graph:
    nodes: dict[str, Node] = field(default_factory=dict)
    wires: list[Wire] = field(default_factory=list)
    kept: list = field(default_factory=list, repr=False, compare=False)  # what the last render with persist keeps

    @staticmethod
    def from_json(text: str) -> Graph:
        said = json.loads(text)
        g = Graph()
        for n in said.get("nodes", []):
            g.add(Node(n["id"], n["type"], n.get("params", {}), n.get("enabled", True), n.get("label", "")))
        for w in said.get("wires", []):
            g.connect(w["from"], w["to"], w.get("port", "in"))
        return g

    def to_json(self) -> str:
        return json.dumps({"nodes": [{"id": n.id, "type": n.type, "params": n.params, "enabled": n.enabled, "label": n.label} for n in sorted(self.nodes.values(), key=lambda n: n.id)], "wires": [{"from": w.from_id, "to": w.to_id, "port": w.to_port} for w in self.wires]}, sort_keys=True)

    def add(self, node: Node) -> None:
        if node.id in self.nodes:
            raise EngineError(f"there is a node {node.id!r} already")
        if node.type not in REGISTRY and node.type not in SOURCES:
            raise EngineError(f"no node type {node.type!r}")
        self.nodes[node.id] = node

    def _node(self, node_id: str) -> Node:
        if node_id not in self.nodes:
            raise EngineError(f"no node {node_id!r}")
        return self.nodes[node_id]

    def remove(self, node_id: str) -> tuple[Node, list[Wire]]:
        gone = self._node(node_id)
        lost = [w for w in self.wires if node_id in (w.from_id, w.to_id)]
        self.wires = [w for w in self.wires if w not in lost]
        del self.nodes[node_id]
        return gone, lost

    def set_param(self, node_id: str, name: str, value):
        """The value it had before, or None."""
        node = self._node(node_id)
        if node.type in REGISTRY and name not in REGISTRY[node.type].params:
            raise EngineError(f"{node.type} has no parameter {name!r}")
        before = node.params.get(name)
        params = {k: v for k, v in node.params.items() if k != name} if value is None else {**node.params, name: value}
        self.nodes[node_id] = replace(node, params=params)
        return before

    def set_enabled(self, node_id: str, enabled: bool) -> bool:
        before = self._node(node_id).enabled
        self.nodes[node_id] = replace(self.nodes[node_id], enabled=enabled)
        return before

    def rename(self, node_id: str, label: str) -> str:
        before = self._node(node_id).label
        self.nodes[node_id] = replace(self.nodes[node_id], label=label)
        return before

    def connect(self, from_id: str, to_id: str, port: str = "in") -> Wire | None:
        """A wire; one that enters the port already is replaced and returned. No node may come before itself, and a picture can't be put where only fields fit."""
        source, target = self._node(from_id), self._node(to_id)
        if target.type in SOURCES:
            raise EngineError("a source takes no input")
        spec = REGISTRY[target.type]
        if port not in (*spec.needs, *spec.takes):
            raise EngineError(f"{target.type} has no port {port!r}")
        if from_id == to_id or self.reaches(to_id, from_id):
            raise EngineError("that would close a circle")
        del source
        old = next((w for w in self.wires if (w.to_id, w.to_port) == (to_id, port)), None)
        self.wires = [w for w in self.wires if w is not old] + [Wire(from_id, to_id, port)]
        return old

    def disconnect(self, to_id: str, port: str) -> Wire:
        found = next((w for w in self.wires if (w.to_id, w.to_port) == (to_id, port)), None)
        if found is None:
            raise EngineError(f"nothing enters {to_id}.{port}")
        self.wires.remove(found)
        return found

    def incoming(self, node_id: str) -> dict[str, str]:
        return {w.to_port: w.from_id for w in self.wires if w.to_id == node_id}

    def reaches(self, start: str, goal: str) -> bool:
        seen, queue = {start}, deque([start])
        while queue:
            at = queue.popleft()
            if at == goal:
                return True
            for w in self.wires:
                if w.from_id == at and w.to_id not in seen:
                    seen.add(w.to_id)
                    queue.append(w.to_id)
        return False

    def order(self) -> list[str]:
        """Nodes with every input before its reader, otherwise by id."""
        left = {n: set(self.incoming(n).values()) for n in self.nodes}
        out: list[str] = []
        while left:
            ready = min(n for n, needs in left.items() if not needs)
            out.append(ready)
            del left[ready]
            for needs in left.values():
                needs.discard(ready)
        return out

    def keys(self, versions: dict[str, str] | None = None) -> dict[str, str]:
        """What each node computes, as a digest of its type, parameters, state and inputs: equal digests, equal results."""
        out: dict[str, str] = {}
        for n in self.order():
            node = self.nodes[n]
            said = [node.type, sorted((k, repr(v)) for k, v in node.params.items()), node.enabled, (versions or {}).get(n, "") if node.type in SOURCES else "", sorted((p, out[i]) for p, i in self.incoming(n).items())]
            out[n] = hashlib.sha256(json.dumps(said).encode()).hexdigest()
        return out

    def render(self, node_id: str, sources: dict[str, Rel], persist: bool = False) -> Rel:
        """The plan of a node over its sources. Nodes that compute the same are built once; with persist, those that several others read are kept."""
        keys = self.keys({n: str(id(r)) for n, r in sources.items()})
        readers: dict[str, int] = {}
        for w in self.wires:
            readers[keys[w.from_id]] = readers.get(keys[w.from_id], 0) + 1
        done: dict[str, Rel] = {}
        kept: list = []

        def build(n: str) -> Rel:
            if keys[n] in done:
                return done[keys[n]]
            node = self._node(n)
            if node.type in SOURCES:
                if n not in sources:
                    raise EngineError(f"no picture for source {n!r}")
                rel = sources[n]
            else:
                rel = run(node.type, {p: build(i) for p, i in self.incoming(n).items()}, node.params, node.enabled)
                if persist and readers.get(keys[n], 0) > 1:
                    rel = replace(rel, df=rel.df.persist())
                    kept.append(rel.df)
            done[keys[n]] = rel
            return rel

        out = build(node_id)
        self.kept = kept
        return out

    def release(self) -> None:
        """Let go of what the last render with persist kept."""
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def run_as(self, node_id: str, sources: dict[str, Rel], group: str, write) -> None:
        """Render a node and write it as a job group of its own, which cancel() ends between and within nodes; write takes the rendered relation. What it kept is let go."""
        rel = self.render(node_id, sources, persist=True)
        context = rel.df.sparkSession.sparkContext
        context.setJobGroup(group, f"render {node_id}", interruptOnCancel=True)
        try:
            write(rel)
        finally:
            self.release()
            context.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark, group: str) -> None:
    """End a render's jobs."""
    spark.sparkContext.cancelJobGroup(group)


def progress(spark, group: str) -> tuple[int, int]:
    """Tasks that a render's jobs have done and have."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if found := tracker.getStageInfo(stage):
                done, total = done + found.numCompletedTasks, total + found.numTasks
    return done, total


def registry_manifest() -> list[dict]:
    """All node types with ports and parameters."""
    return [{"type": s.name, "needs": list(s.needs), "takes": list(s.takes), "gives": s.gives, "params": {k: {"default": p.default, "low": p.low, "high": p.high, "choices": list(p.choices)} for k, p in s.params.items()}} for s in sorted(REGISTRY.values(), key=lambda s: s.name)]


@dataclass(frozen=True)
class Group:
    """A graph kept for use in others: ports of some nodes are its inputs, one node is its output, some parameters are open."""

    graph: Graph
    inputs: dict[str, tuple[str, str]]
    output: str
    exposed: dict[str, tuple[str, str]] = field(default_factory=dict)

    def place(self, into: Graph, prefix: str, feeds: dict[str, str], params: dict | None = None) -> str:
        """Copied into a graph under a prefix and wired; the id of its output."""
        for n in self.graph.nodes.values():
            into.add(replace(n, id=f"{prefix}{n.id}", params=dict(n.params)))
        for w in self.graph.wires:
            into.connect(f"{prefix}{w.from_id}", f"{prefix}{w.to_id}", w.to_port)
        for name, source in feeds.items():
            node, port = self.inputs[name]
            into.connect(source, f"{prefix}{node}", port)
        for name, value in (params or {}).items():
            node, param = self.exposed[name]
            into.set_param(f"{prefix}{node}", param, value)
        return f"{prefix}{self.output}"


__all__ = ["Graph", "Group", "Node", "Wire", "registry_manifest", "IMAGE"]
