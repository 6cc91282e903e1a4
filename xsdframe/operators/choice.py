"""Choice checks.

A complex type's choices are first put together as trees: a choice has branches, a branch
has fields of its own and may hold further choices. Each branch then has a state in a
document, as a number: ABSENT, PARTIAL (something of it is there, but not all that must be)
or WHOLE; a choice holds if no branch is partial and the number of whole ones is in the
range that its occurrence allows. A whole branch is passed over if a larger whole branch
has all of its names, as the larger one explains what is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column

from ..functions import F, let
from ..ir import ComplexType, Field

Has = Callable[[Field], Column]
ABSENT, PARTIAL, WHOLE = 0, 1, 2


def _some(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


@dataclass
class Branch:
    """What may stand in one place of a choice."""

    fields: list[Field] = field(default_factory=list)
    choices: list[Choice] = field(default_factory=list)

    def all_fields(self) -> list[Field]:
        return self.fields + [f for c in self.choices for b in c.branches for f in b.all_fields()]

    @property
    def names(self) -> frozenset[str]:
        return frozenset(f.qname for f in self.all_fields())

    def present(self, has: Has) -> Column:
        return _some([has(f) for f in self.all_fields()])

    def whole(self, has: Has) -> Column:
        """All required fields are there (any, if none is), and the choices inside hold."""
        needed = [f for f in self.fields if f.card.least > 0]
        base = [has(f) for f in needed] or [_some([has(f) for f in self.fields]) if self.fields else self.present(has)]
        return reduce(lambda a, b: a & b, base + [c.holds(has) for c in self.choices if c.asks])

    @property
    def divisible(self) -> bool:
        """Whether it can be there in part: a required field has company, or a choice inside asks
        for something."""
        return (len(self.fields) > 1 and any(f.card.least > 0 for f in self.fields)) or any(c.asks for c in self.choices)

    def state(self, has: Has) -> Column:
        state = F.when(self.whole(has), WHOLE)
        return (state.when(self.present(has), PARTIAL) if self.divisible else state).otherwise(ABSENT)


@dataclass
class Choice:
    """repeated: it may occur more than once; open: a wildcard is one of its branches."""

    branches: list[Branch]
    repeated: bool
    optional: bool
    open: bool
    #: The branch that it stands in, if it is inside another choice.
    inside: Branch | None = None

    @property
    def asks(self) -> bool:
        """Whether any document could fail it. A choice of one branch is that branch's own matter."""
        return len(self.branches) > 1 and not self.open and not (self.repeated and self.optional)

    def _larger(self, k: int) -> list[int]:
        """Branches that have all names of the k-th; of equal ones the first counts."""
        own = self.branches[k].names
        return [i for i, b in enumerate(self.branches) if own < b.names or (own == b.names and i < k)] if own else []

    def holds(self, has: Has) -> Column:
        """Whether the choice is satisfied, with the choices inside it."""

        def judge(states: Column) -> Column:
            whole = []
            for k in range(len(self.branches)):
                over = _some([states[i] == WHOLE for i in self._larger(k)]) if self._larger(k) else None
                is_whole = states[k] == WHOLE
                whole.append((is_whole if over is None else is_whole & ~over).cast("int"))
            n = reduce(lambda a, b: a + b, whole)
            right = n >= 1 if self.repeated else n <= 1 if self.optional else n == 1
            partial = [states[k] == PARTIAL for k, b in enumerate(self.branches) if b.divisible]
            return right & ~_some(partial) if partial else right

        return let(F.array(*(b.state(has) for b in self.branches)), judge)

    def checked(self, has: Has) -> Column:
        """As holds(), but a choice inside a branch is only asked where the branch is there."""
        return self.holds(has) if self.inside is None else ~self.inside.present(has) | self.holds(has)

    def message(self) -> str:
        options = " or ".join(" with ".join(dict.fromkeys(f.key for f in b.fields or b.all_fields())) for b in self.branches)
        if self.repeated:
            return f"none is there of {options}"
        return f"{'more than one is' if self.optional else 'not just one is'} there, and whole, of {options}"


def choices_of(t: ComplexType, fields: list[Field]) -> Iterator[Choice]:
    """All choices of a type over those of its fields that a plan has, outer ones first."""
    made: dict[int, Choice] = {}
    places: dict[tuple[int, int], Branch] = {}

    def branch(group: int, number: int) -> Branch:
        return places.setdefault((group, number), Branch())

    for f in fields:
        if f.group is not None:
            branch(f.group, f.branch).fields.append(f)
    for group, card in t.groups.items():
        own = [f for f in fields if f.group == group]
        optional = any(f.card.least == 0 for f in own) if own else card.least == 0
        wild = any(w.kind == "any" and w.group == group for w in t.wildcards)
        made[group] = Choice([], card.repeated, optional, wild)
    for inner, (outer, number) in t.guards.items():
        place = branch(outer, number)
        place.choices.append(made[inner])
        made[inner].inside = place
    for group, number in sorted(places):
        made[group].branches.append(places[group, number])
    return iter(made.values())


def checks(t: ComplexType, fields: list[Field], has: Has) -> list[tuple[Column, str]]:
    """(holds, message) of every choice that asks for something."""
    return [(c.checked(has), c.message()) for c in choices_of(t, fields) if c.asks]
