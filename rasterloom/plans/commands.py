"""Commands on a graph, with undo and redo."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from rasterloom.operators.node import EngineError
from rasterloom.plans.graph import Graph, Node, Wire


@dataclass
class Journal:
    """Applies commands and can take them back. A command is (name, arguments...); a batch is all or nothing."""

    graph: Graph = field(default_factory=Graph)
    undone: list[tuple] = field(default_factory=list)
    done: list[tuple] = field(default_factory=list)

    def _apply(self, command: tuple) -> tuple:
        """Apply one command; its inverse."""
        name, *a = command
        g = self.graph
        if name == "create_node":
            g.add(Node(*a))
            return ("delete_node", a[0])
        if name == "delete_node":
            node, wires = g.remove(a[0])
            return ("restore_node", node, wires)
        if name == "restore_node":
            node, wires = a
            g.add(node)
            for w in wires:
                g.connect(w.from_id, w.to_id, w.to_port)
            return ("delete_node", node.id)
        if name == "set_param":
            return ("set_param", a[0], a[1], g.set_param(*a))
        if name == "set_enabled":
            return ("set_enabled", a[0], g.set_enabled(*a))
        if name == "rename_node":
            return ("rename_node", a[0], g.rename(*a))
        if name == "connect":
            old: Wire | None = g.connect(*a)
            port = a[2] if len(a) > 2 else "in"
            return ("connect", old.from_id, a[1], port) if old else ("disconnect", a[1], port)
        if name == "disconnect":
            w = g.disconnect(*a)
            return ("connect", w.from_id, w.to_id, w.to_port)
        if name == "batch":
            before, back = Graph(copy.deepcopy(g.nodes), copy.deepcopy(g.wires), g.kept), []
            try:
                for c in a[0]:
                    back.append(self._apply(c))
            except EngineError:
                self.graph = before
                raise
            return ("batch", back[::-1])
        raise EngineError(f"no command {name!r}")

    def apply(self, command: tuple) -> None:
        self.done.append((command, self._apply(command)))
        self.undone.clear()

    def undo(self) -> bool:
        if not self.done:
            return False
        command, inverse = self.done.pop()
        self._apply(inverse)
        self.undone.append((command, inverse))
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        command, _ = self.undone.pop()
        self.done.append((command, self._apply(command)))
        return True
