"""Migrations: phases, progress and the ordered fold of their operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import folded

CUTOVER_PENDING = 64
#: Phases that may follow; aborting is allowed up to the cutover, failing until the end.
NEXT = {"planned": {"copying"}, "copying": {"catching_up"}, "catching_up": {"cutover", "copying"}, "cutover": {"cleanup"}, "cleanup": {"completed"}}
BEFORE_CUTOVER = {"planned", "copying", "catching_up", "cutover"}
TERMINAL = {"completed", "aborted", "failed"}
# Overall progress at the beginning of a phase.
PROGRESS = {"catching_up": 0.85, "cutover": 0.95, "cleanup": 0.98, "completed": 1.0}


def copy_fraction(copied: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(copied / total)


def overall_fraction(phase: Column, copied: Column, total: Column) -> Column:
    out = F.when(phase == "copying", copy_fraction(copied, total) * 0.80).otherwise(F.lit(0.0))
    for name, value in PROGRESS.items():
        out = F.when(phase == name, value).otherwise(out)
    return out


def pending(high: Column, applied: Column) -> Column:
    return F.when(high.isNull(), 0).when(applied.isNull(), high + 1).otherwise(F.greatest(high - applied, F.lit(0))).cast("bigint")


class Migration:
    """The state of one migration; every operation gives None or the reason it was refused."""

    def __init__(self, total: int):
        self.phase, self.total, self.copied = "planned", total, 0
        self.high = self.applied = self.fence = None
        self.cut_over = False

    def _to(self, phase: str) -> str | None:
        allowed = phase in NEXT.get(self.phase, ()) or (phase == "aborted" and self.phase in BEFORE_CUTOVER) or (phase == "failed" and self.phase not in TERMINAL)
        if not allowed:
            return "illegal_transition"
        self.phase = phase
        return None

    def pending(self) -> int:
        return 0 if self.high is None else self.high + 1 if self.applied is None else max(self.high - self.applied, 0)

    def apply(self, op: str, n: int | None) -> str | None:
        return getattr(self, f"_{op}")(n)

    def _write(self, seq):
        if self.phase == "cutover":
            return "write_fenced"
        if self.cut_over:
            if (self.fence is not None and seq <= self.fence) or (self.applied is not None and seq <= self.applied):
                return "write_already_applied"
            self.applied = seq
        elif self.high is not None and seq <= self.high:
            return "non_monotonic_write"
        else:
            self.high = seq
        return None

    def _applied(self, seq):
        if self.high is None or seq > self.high:
            return "unknown_write"
        if self.applied is not None and seq <= self.applied:
            return "write_already_applied"
        self.applied = seq
        return None

    def _begin_copy(self, _):
        return self._to("copying")

    def _copied(self, atoms):
        if self.phase != "copying":
            return "wrong_phase"
        if atoms > self.total:
            return "progress_exceeds_total"
        if atoms < self.copied:
            return "progress_went_backwards"
        self.copied = atoms
        return None

    def _catch_up(self, _):
        if self.phase != "copying":
            return "wrong_phase"
        return "copy_incomplete" if self.copied < self.total else self._to("catching_up")

    def _restart(self, _):
        if self.phase != "catching_up":
            return "wrong_phase"
        self.copied, self.applied = 0, None
        return self._to("copying")

    def _begin_cutover(self, _):
        if self.phase != "catching_up":
            return "wrong_phase"
        if self.pending() > CUTOVER_PENDING:
            return "not_caught_up"
        self.fence = self.high
        return self._to("cutover")

    def _complete_cutover(self, _):
        if self.phase != "cutover":
            return "wrong_phase"
        if self.pending():
            return "cutover_not_drained"
        self.cut_over = True
        return self._to("cleanup")

    def _complete(self, _):
        return self._to("completed") if self.phase == "cleanup" else "wrong_phase"

    def _abort(self, _):
        if self.phase in TERMINAL:
            return "already_terminal"
        if self.phase not in BEFORE_CUTOVER:
            return "abort_after_cutover"
        self.fence = self.applied = None
        return self._to("aborted")

    def _fail(self, _):
        return "already_terminal" if self.phase in TERMINAL else self._to("failed")


_FOLDED = ["migration_id", "phase", "copied", "pending_writes", "read_owner", "write_owner", "refused", "last_refusal"]


def fold(scripts: DataFrame) -> DataFrame:
    """migration_id, phase, copied, pending_writes, read_owner, write_owner, refused, last_refusal.

    `scripts` has migration_id, seq, op (write, applied, begin_copy, copied, catch_up, restart, begin_cutover,
    complete_cutover, complete, abort, fail), n, atoms_total, source, destination. A refused operation changes nothing.
    """

    columns = ["migration_id", "seq", "op", "n", "atoms_total", "source", "destination"]

    def run(batches):
        # Rows come sorted, so one migration is held at a time, however many a task has.
        out, now, m, owners = [], None, None, None
        refused, last = 0, None

        def row():
            owner = owners[1] if m.cut_over else owners[0]
            return (now, m.phase, m.copied, m.pending(), owner, None if m.phase == "cutover" else owner, refused, last)

        for b in batches:
            for key, _, op, n, total, source, destination in zip(*[b[c].tolist() for c in columns]):
                if key != now:
                    if m is not None:
                        out.append(row())
                    now, m, owners, refused, last = key, Migration(int(total)), (source, destination), 0, None
                reason = m.apply(op, None if n is None or n != n else int(n))
                if reason:
                    refused, last = refused + 1, reason
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=_FOLDED)
                out = []
        if m is not None:
            out.append(row())
        yield pd.DataFrame(out, columns=_FOLDED)

    return folded(scripts.select(*columns), ["migration_id"], ["seq"], run, "migration_id bigint, phase string, copied bigint, pending_writes bigint, read_owner string, write_owner string, refused bigint, last_refusal string")
