"""User rewards next to the built-in ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import rewards as R
from gradus.functions.views import VIEWS, TextViews

_registered: dict[str, tuple[R.Reward, tuple[str, ...]]] = dict(R.BUILT_IN)


def register_reward(
    name: str, reward: R.Reward, needs: Iterable[str] = ()
) -> None:
    """Make ``reward(views) -> Column`` available to ``score`` as ``name``.

    ``needs`` lists the derived views it reads (see ``gradus.functions.views``);
    ``content`` and ``answer`` are always there.
    """
    needs = tuple(needs)
    unknown = set(needs) - set(VIEWS)
    if unknown:
        raise ValueError(f"unknown views: {sorted(unknown)}")
    _registered[name] = (reward, needs)


def unregister_reward(name: str) -> None:
    if name in R.BUILT_IN:
        _registered[name] = R.BUILT_IN[name]
    else:
        _registered.pop(name, None)


def lookup(name: str) -> tuple[R.Reward, tuple[str, ...]]:
    try:
        return _registered[name]
    except KeyError:
        raise KeyError(
            f"unknown reward {name!r}; known: {', '.join(sorted(_registered))}"
        ) from None


def reward(name: str, content: Column, answer: Column | None = None) -> Column:
    """One reward as a plain Column expression."""
    build, _ = lookup(name)
    return build(TextViews.inline(content, answer)).alias(name)


def batch_reward(
    func: Callable[..., list[float]],
    prompts: Column,
    completions: Column,
    answer: Column,
    **columns: Column,
) -> Column:
    """Run an existing Python reward over Arrow batches.

    ``func(prompts, completions, answer, **columns) -> list[float]`` gets plain
    lists aligned by row, one call per Arrow batch; a reward of None is null. Use it for rules that need
    Python; the built-in rewards do not. An error ends the job; see ``caught_reward``.
    """
    names = ("prompts", "completions", "answer", *columns)

    @F.arrow_udf("double")
    def run(*arrays):
        import pyarrow as pa

        batch = {n: a.to_pylist() for n, a in zip(names, arrays)}
        values = list(func(**batch))
        if len(values) != len(arrays[0]):
            raise ValueError(f"{len(values)} rewards for {len(arrays[0])} completions")
        floats = [None if x is None else float(x) for x in values]
        return pa.array(floats, type=pa.float64())

    return run(prompts, completions, answer, *columns.values())


#: What ``caught_reward`` gives for a row.
CAUGHT = "struct<value:double,error:string>"


def caught_reward(
    func: Callable[..., list[float]],
    prompts: Column,
    completions: Column,
    answer: Column,
    **columns: Column,
) -> Column:
    """Like ``batch_reward``, as a struct of ``value`` and ``error``: one of both is
    null, or both where the reward is None.

    A batch that fails is halved until the rows that fail stand alone, so a bad row
    costs some more calls and loses its own value only. A call that returns the wrong
    number of values, or something that is no number, has failed. Give the rows with an
    error to ``quarantine``; ``split_errors`` does both.
    """
    names = ("prompts", "completions", "answer", *columns)

    @F.arrow_udf(CAUGHT)
    def run(*arrays):
        import pyarrow as pa

        batch = {n: a.to_pylist() for n, a in zip(names, arrays)}
        size = len(arrays[0])
        values, errors = [None] * size, [None] * size
        parts = [(0, size)] if size else []
        while parts:
            lo, hi = parts.pop()
            try:
                got = list(func(**{n: v[lo:hi] for n, v in batch.items()}))
                if len(got) != hi - lo:
                    raise ValueError(f"{len(got)} rewards for {hi - lo} completions")
                values[lo:hi] = [None if x is None else float(x) for x in got]
            except Exception as error:  # whatever a user's rule raises
                if hi - lo == 1:
                    errors[lo] = f"{type(error).__name__}: {error}"
                else:
                    middle = (lo + hi) // 2
                    parts += [(lo, middle), (middle, hi)]
        fields = [pa.field("value", pa.float64()), pa.field("error", pa.string())]
        columns = [pa.array(values, pa.float64()), pa.array(errors, pa.string())]
        return pa.StructArray.from_arrays(columns, fields=fields)

    # Asked for twice (value and error), called once.
    return run.asNondeterministic()(prompts, completions, answer, *columns.values())


def split_errors(df: DataFrame, caught: str) -> DataFrame:
    """Rows with the struct column ``caught`` replaced by its value, and ``error`` for
    ``quarantine``: an error that was there before stays."""
    kept = [c for c in df.columns if c not in (caught, "error")]
    own = F.col(caught).getField("error")
    error = F.coalesce(F.col("error"), own) if "error" in df.columns else own
    return df.select(
        *kept, F.col(caught).getField("value").alias(caught), error.alias("error")
    )
