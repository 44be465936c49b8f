"""Detection over a bounded set of events."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.scalars import alert_id
from tidemark.operators.cooldown import admit, numbered
from tidemark.operators.frames import event_frames
from tidemark.operators.rules import hits, write_up
from tidemark.operators.validate import split_valid
from tidemark.profiles import Profile, by_stream
from tidemark.schema import ALERT


def as_alerts(admitted: DataFrame) -> DataFrame:
    """Stamp ids and keep the alert columns."""
    # A further rule of the same kind may find the same event.
    event = F.concat("event_id", F.when(F.col("which") > 0, F.concat(F.lit("#"), "which")).otherwise(""))
    made = alert_id(F.col("rule"), F.col("stream"), F.col("key"), event)
    return admitted.withColumn("id", made).select(ALERT.fieldNames())


@dataclass(frozen=True)
class Detection:
    events: DataFrame
    profiles: Mapping[str, Profile]
    as_of: datetime | None = None

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        return split_valid(self.events, self.profiles)

    @property
    def invalid(self) -> DataFrame:
        """Rejected events with their ``reason``."""
        return self._split[1]

    @cached_property
    def frames(self) -> DataFrame:
        as_of = self.as_of
        if as_of is None and any(p.stall for p in self.profiles.values()):
            as_of = self._split[0].agg(F.max(F.unix_micros("at"))).first()[0]
        return event_frames(self._split[0], self.profiles, as_of)

    @cached_property
    def hits(self) -> DataFrame:
        """What the rules found, as facts (see ``rules.hits``); lazy."""
        return hits(self.frames, self.profiles)

    @property
    def candidates(self) -> DataFrame:
        """Everything the rules found, written up, before the cooldown; lazy."""
        return write_up(self.hits, self.profiles)

    @cached_property
    def _run(self) -> tuple[DataFrame, Observation]:
        """The hits written once, and what the run that wrote them counted on its way."""
        flow = Observation("detection")
        frames = self.frames.observe(flow, F.count_if("own").alias("processed"), F.count_if("stalled").alias("swept"))
        return numbered(hits(frames, self.profiles)), flow

    @cached_property
    def staged(self) -> DataFrame:
        """The hits written once to the shared folder: the cooldown reads them more than
        once, and the rules should not run again for that."""
        return self._run[0]

    @cached_property
    def admitted(self) -> DataFrame:
        return admit(self.staged, self.profiles)

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts in the ``ALERT`` schema."""
        return as_alerts(write_up(self.admitted, self.profiles))

    @property
    def counters(self) -> DataFrame:
        """One row: processed, alerted, suppressed, late, swept, invalid. What was processed and swept the run itself has counted; only rejected
        events, which it does not see, are counted apart."""
        staged, flow = self._run
        return counted(seen(flow, "processed", "swept") | {"late": 0}, staged, self.admitted, self.invalid)


def seen(flow: Observation, *names: str) -> dict[str, int]:
    """What an observation has counted. A run over no rows at all may be planned away with its counters."""
    try:
        return flow.get
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


def counted(flow: Mapping[str, int], staged: DataFrame, admitted: DataFrame, invalid: DataFrame) -> DataFrame:
    """The counters of a run from its observed ``flow`` and the tables it has written."""
    names = ("alerted", "found", "invalid")
    def tally(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(*[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in names])
    parts = tally(admitted, "alerted").unionByName(tally(staged.filter("rule != ''"), "found")).unionByName(tally(invalid, "invalid"))
    total = parts.agg(*[F.sum(c).alias(c) for c in names])
    observed = {c: F.lit(flow[c]).cast("long").alias(c) for c in ("processed", "late", "swept")}
    return total.select(
        observed["processed"], "alerted", (F.col("found") - F.col("alerted")).alias("suppressed"), observed["late"], observed["swept"], "invalid"
    )


def detect(
    events: DataFrame, profiles: Iterable[Profile], as_of: datetime | None = None
) -> Detection:
    """Run every profile's rules over ``events``, taken in event-time order.

    ``as_of`` is the present for absence rules; without it, the newest event's time.
    For input whose arrival order matters (late and out-of-order records) use
    ``tidemark.operators.replay``.
    """
    return Detection(events, by_stream(profiles), as_of)
