"""Models on the executors: weights loaded once for each task's stream of batches, and calls of an outside service under
one limit for the whole cluster."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.angles import STEP, START
from shotlens.session import materialise, ship

#: What a loaded model is: a batch of inputs to one array of logits (rows, bins) for each angle.
Predict = Callable[[pd.Series], Sequence[np.ndarray]]


def expected_angles(logits: np.ndarray, step: float = STEP, start: float = START) -> np.ndarray:
    """Radians of the soft-max expectation of each row."""
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return np.radians((e @ np.arange(logits.shape[1])) / e.sum(axis=1) * step + start)


def run_gaze(crops: DataFrame, load: Callable[[], Predict], image: str, names: Sequence[str] = ("pitch", "yaw"), profile: ResourceProfile | None = None, step: float = STEP, start: float = START) -> DataFrame:
    """The crops with an angle in radians for each of `names`; of a crop without an image they are null.

    `load` runs once in a task, before its first batch, and not in a task without rows; `profile` asks for what the model
    needs (a GPU, say) for this stage alone."""
    ship(crops.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for b in batches:
            there = b[image].notna().to_numpy()
            out = {n: np.full(len(b), np.nan) for n in names}
            if there.any():
                predict = predict or load()
                for n, logits in zip(names, predict(b.loc[there, image]), strict=True):
                    out[n][there] = expected_angles(np.asarray(logits, float), step, start)
            yield b.assign(**{n: pd.array(np.where(there, v, np.nan), "Float64").copy() for n, v in out.items()})

    return crops.mapInPandas(run, f"{kinds}, " + ", ".join(f"`{n}` double" for n in names), profile=profile).withColumns({n: F.nullif(n, F.lit(float("nan"))) for n in names})


class Bucket:
    """Tokens that come at an even rate; at most `most` are saved up."""

    def __init__(self, rate: float, most: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.most, self.clock, self.sleep = rate, most, clock, sleep
        self.held, self.at = 0.0, clock()

    def take(self) -> None:
        """Wait for a token."""
        while True:
            now = self.clock()
            self.held, self.at = min(self.most, self.held + (now - self.at) * self.rate), now
            if self.held >= 1 - 1e-9:
                self.held -= 1
                return
            self.sleep((1 - self.held) / self.rate)


def call_all(tasks: DataFrame, load: Callable[[], Callable[[str], str]], key: str, prompt: str, per_second: float, parts: int, is_limit: Callable[[Exception], bool], rounds: int = 5, name: str = "answers") -> tuple[DataFrame, DataFrame]:
    """Answers (key, answer, error) of tasks from a service that takes `per_second` calls, and the tasks that got none.

    Each of `parts` tasks has an even share of the budget and spends it by a token bucket that starts empty, so that
    the calls of all of them, repeated tasks too, stay under it, whatever the number of executors. A call that the service
    puts off (`is_limit`) isn't tried again at once: its row goes to the table of the next round, up to `rounds` of them. Other
    errors are final, and their text is in `error`. Each round's answers are written before the next begins: calls cost."""
    spark = tasks.sparkSession
    ship(spark)
    kind = tasks.schema[key].dataType.simpleString()
    todo, done = materialise(spark, tasks.select(key, prompt).repartition(parts), f"{name}-tasks"), None
    for attempt in range(rounds):

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call, bucket = None, Bucket(per_second / parts)
            for b in batches:
                call = call or load()
                answers, errors = [], []
                for text in b[prompt].tolist():
                    bucket.take()
                    try:
                        answers.append(call(text))
                        errors.append(None)
                    except Exception as e:
                        answers.append(None)
                        errors.append("" if is_limit(e) else f"{type(e).__name__}: {e}")
                yield pd.DataFrame({key: b[key], prompt: b[prompt], "answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object)})

        # a partition for each share, however small: coalescing would only slow the calls down
        got = todo.repartition(parts).mapInPandas(run, f"`{key}` {kind}, `{prompt}` string, answer string, error string")
        got = materialise(spark, got, f"{name}-{attempt}")
        ended = got.where("error IS NULL OR error <> ''").select(key, "answer", "error")
        done = ended if done is None else done.unionByName(ended)
        todo = got.where("error = ''").select(key, prompt)
        if todo.isEmpty():
            break
    return done, todo
