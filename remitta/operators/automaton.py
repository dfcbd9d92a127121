"""Segments to loops. The open loops are always the innermost one and its parents, so the state is one loop.

What a segment does in a state depends on its id and on the elements that triggers of that id look at; each such case
is worked out once and looked up from then on.
"""

from __future__ import annotations

import dataclasses

from remitta.operators.lexer import Segment
from remitta.plans.spec import Spec


@dataclasses.dataclass(frozen=True, slots=True)
class Move:
    """closes (innermost first), opens (loop, implicit), the loop that holds the segment, whether that closes then, the next state."""

    closes: tuple[int, ...]
    opens: tuple[tuple[int, bool], ...]
    holder: int | None
    ends: bool
    state: int | None


class Automaton:
    def __init__(self, spec: Spec):
        self.spec = spec
        self.moves: dict[tuple, Move] = {}
        self.looked_at: dict[bytes, tuple[int, ...]] = {}
        for x in spec.loops:
            self.looked_at[x.trigger] = tuple(sorted({*self.looked_at.get(x.trigger, ()), *(p for p, _ in x.where)}))
        self.held = [self._held(x) for x in spec.loops]
        self.places: list[dict[bytes, tuple]] = [self._places(x) for x in spec.loops]

    @staticmethod
    def _opened_on(loop, o) -> bool:
        where = dict(loop.where)
        return o.segment == loop.trigger and (o.element is None or o.element not in where or where[o.element] in o.values)

    def _held(self, loop) -> frozenset[bytes]:
        return frozenset([o.segment for o in loop.occurrences if not self._opened_on(loop, o)] + ([loop.end] if loop.end else []))

    @staticmethod
    def _places(loop) -> dict[bytes, tuple]:
        """Segment id -> (element, component, index by code) or (None, None, index)."""
        out: dict[bytes, tuple] = {}
        for i, o in enumerate(loop.occurrences):
            if o.element is None:
                out.setdefault(o.segment, (None, None, i))
            else:
                out.setdefault(o.segment, (o.element, o.component, {}))[2].update(dict.fromkeys(o.values, i))
        return out

    def occurrence(self, loop: int, s: Segment) -> int | None:
        found = self.places[loop].get(s.id)
        if found is None:
            return None
        element, component, index = found
        return index if element is None else index.get(s.leaf(element, component))

    def move(self, state: int | None, s: Segment) -> Move:
        looked = self.looked_at.get(s.id)
        seen = tuple([s.simple(p) for p in looked]) if looked else ()
        key = (state, s.id, seen)
        got = self.moves.get(key)
        if got is None:
            if len(self.moves) > 100_000:
                self.moves.clear()
            got = self.moves[key] = self._work_out(state, s.id, dict(zip(looked or (), seen)))
        return got

    def _match(self, loops, id: bytes, seen: dict) -> int | None:
        """The loop whose trigger has most conditions, all true; the first of equals."""
        fit = [x for x in loops if self.spec.loops[x].trigger == id and all(seen.get(p) == v for p, v in self.spec.loops[x].where)]
        return max(fit, key=lambda x: (len(self.spec.loops[x].where), -x), default=None)

    def _work_out(self, state: int | None, id: bytes, seen: dict) -> Move:
        loops, stack = self.spec.loops, self.spec.chain(state)
        cut = lambda depth: tuple(reversed(stack[depth:]))
        roots = [x.index for x in loops if x.parent is None]
        for depth in range(len(stack), -1, -1):
            child = self._match(loops[stack[depth - 1]].children if depth else roots, id, seen)
            if child is not None:
                return Move(cut(depth), ((child, False),), child, False, child)
        for depth in range(len(stack), 0, -1):
            loop = loops[stack[depth - 1]]
            if id in self.held[loop.index]:
                ends = loop.end == id
                return Move(cut(depth), (), loop.index, ends, loop.parent if ends else loop.index)
        target = self._match([x.index for x in loops], id, seen)
        if target is None:
            return Move((), (), None, False, state)
        chain = self.spec.chain(target)[:-1]
        common = max((i + 1 for i, x in enumerate(chain) if x in stack), default=0)
        depth = stack.index(chain[common - 1]) + 1 if common else 0
        return Move(cut(depth), (*((x, True) for x in chain[common:]), (target, False)), target, False, target)
