"""Places where a caller's own function takes part: each is named by path or given as it is, and its result is checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.rewards import load_hook

Hook = str | Callable


def hook(given: Hook) -> Callable:
    return load_hook(given) if isinstance(given, str) else given


def frame(given: Hook, *args, needs: tuple[str, ...] = ()) -> DataFrame:
    """What the function makes of its tables, if it is a table with the columns that are needed."""
    out = hook(given)(*args)
    if not isinstance(out, DataFrame):
        raise TypeError("the function has to return a table")
    if missing := [c for c in needs if c not in out.columns]:
        raise ValueError(f"the function's table lacks {missing}")
    return out


def post_process_rewards(given: Hook, samples: DataFrame) -> DataFrame:
    """The whole batch's rewards as they were and as they are trained on."""
    return frame(given, samples, needs=("raw_reward", "reward"))


def convert_samples(given: Hook, samples: DataFrame) -> DataFrame:
    """The whole batch as training rows."""
    return frame(given, samples, needs=("tokens", "loss_mask"))


def buffered(given: Hook | None, buffer: DataFrame, n: int, order: str, group: str) -> DataFrame:
    """The groups that leave a buffer; without a function the first n by order."""
    if given is not None:
        return frame(given, buffer, n, needs=(group,))
    first = buffer.groupBy(group).agg(F.min(order).alias("_o")).orderBy("_o", group).limit(n).select(group)
    return buffer.join(first, group, "left_semi")


def filter_samples(given: Hook, samples: DataFrame) -> DataFrame:
    """Samples with remove_sample, which keeps a row and takes it out of the loss."""
    return frame(given, samples, needs=(*samples.columns, "remove_sample"))


def see_all_samples(given: Hook, samples: DataFrame) -> DataFrame:
    """What the function reports on all groups, those that filters dropped as well."""
    return frame(given, samples)


def post_process_rollout(given: Hook, batch: DataFrame) -> DataFrame:
    return frame(given, batch, needs=tuple(batch.columns))


def generate(given: Hook, prompts: DataFrame) -> DataFrame:
    """Samples with a response, from a function that stands for a model."""
    return frame(given, prompts, needs=("response", "status"))


def rollout(given: Hook, prompts: DataFrame, rollout_id: int, evaluation: bool = False) -> DataFrame:
    """A whole rollout's samples."""
    return frame(given, prompts, rollout_id, evaluation, needs=("response", "status", "reward"))


def log(given: Hook | None, metrics: DataFrame, default: Callable) -> bool:
    """Calls the function, and the default unless it returns true; whether the default was called."""
    if given is not None and hook(given)(metrics) is True:
        return False
    default(metrics)
    return True


def token_loss(given: Hook, *cols: Column) -> Column:
    """A column from a function of columns: a loss, or importance weights."""
    out = hook(given)(*cols)
    if not isinstance(out, Column):
        raise TypeError("the function has to return a column")
    return out


def dynamic_filter(given: Hook | None, samples: DataFrame, group: str) -> DataFrame:
    """(group, keep, reason): the function's aggregate over each group, a truth value or a struct (keep, reason).

    Without a function every group is kept. A null verdict is none.
    """
    if given is None:
        return samples.groupBy(group).agg(F.lit(True).alias("keep"), F.lit(None).cast("string").alias("reason"))
    out = samples.groupBy(group).agg(hook(given)().alias("_v"))
    kind = out.schema["_v"].dataType.simpleString()
    keep, reason = ("_v", F.lit(None).cast("string")) if kind == "boolean" else ("_v.keep", F.col("_v.reason"))
    return out.select(group, F.coalesce(F.col(keep), F.lit(False)).alias("keep"), reason.alias("reason"))


class TableSource:
    """A source of prompts that serves groups in order, takes unfinished ones back first, and can be saved.

    What is taken back lies in a table in the caller's hands; the place in the order is one number.
    """

    def __init__(self, rows: DataFrame, order: str, at: int = 0, returned: DataFrame | None = None):
        self.rows, self.order, self.at, self.returned = rows, order, at, returned

    def get(self, n: int) -> DataFrame:
        """The next n rows: those that came back, then the table's."""
        out = None
        if self.returned is not None:
            out = self.returned.orderBy(self.order).limit(n)
            back = out.count()
            self.returned = self.returned.join(out.select(self.order), self.order, "left_anti") if back == n else None
            n -= back
        new = self.rows.where(F.col(self.order) >= self.at).orderBy(self.order).limit(n)
        if n:
            last = new.agg(F.max(self.order)).first()[0]
            self.at = self.at if last is None else last + 1
        return new if out is None else out.unionByName(new)

    def add(self, rows: DataFrame) -> None:
        self.returned = rows if self.returned is None else self.returned.unionByName(rows)

    def save(self) -> dict:
        return {"at": self.at}

    def load(self, state: dict) -> None:
        self.at = state["at"]
