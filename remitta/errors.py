"""What is raised, as opposed to reported as a finding. Each message names the rule, the place and the value."""

from __future__ import annotations

from remitta.functions.values import ConvertError, ElementTextError  # noqa: F401
from remitta.operators.lexer import NotAnInterchange  # noqa: F401
from remitta.plans.spec import SpecError  # noqa: F401


class ReadError(ValueError):
    """Reading can't begin or go on: options, paths, a file that is no 835, text that is not UTF-8."""


class MaskError(ReadError):
    """The key is too short, or the date mode unknown."""


class SchemaError(ValueError):
    """Options of the schema listing."""


class SummaryError(ValueError):
    """An undeclared summary, or tables that don't have what it reads."""


class CopyError(ValueError):
    """Options or rows that can't be written."""


class PlanError(ValueError):
    """The specification itself can't be written."""


class WriteError(ValueError):
    """Rows that don't make a valid file; `findings` tells why."""

    def __init__(self, message: str, findings: list = ()):
        super().__init__(message)
        self.findings = list(findings)


class CellError(ValueError):
    """A value that a column can't hold."""

    def __init__(self, kind: str, value):
        self.kind, self.value = kind, value
        super().__init__(f"a column of kind {kind} cannot hold a {type(value).__name__} value ({value!r})")


class RowError(ValueError):
    """A row of the wrong length, or with a cell that does not fit."""


class SegmentWriteError(ValueError):
    """A value that holds a delimiter where no release byte can stand before it."""

    def __init__(self, byte: bytes, element: int, component: int | None):
        self.byte, self.element, self.component = byte, element, component
        where = "segment id" if element == 0 else f"element {element}" + ("" if component is None else f", component {component}")
        super().__init__(f"{where} holds the delimiter {byte.decode('latin-1')!r}, and no release byte is set")
