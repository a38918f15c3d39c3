"""Label encodings: index lists, multi-hot and one-hot arrays, permutations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Label lists in their index order.
TWEET_LABELS = [
    "anger", "anticipation", "disgust", "fear", "joy", "love", "optimism",
    "pessimism", "sadness", "surprise", "trust",
]
STATEMENT_LABELS = ["fear", "anger", "guilt", "joy", "disgust", "shame", "sadness"]
STANCE_LABELS = [
    "anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust",
]
DIALOGUE_LABELS = [
    "anger", "happy", "sadness", "frustrate", "excite", "fear", "surprise", "disgust",
    "neutral",
]
FORUM_LABELS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism",
    "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral",
]
EKMAN_LABELS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
VAD_AXES = ["V", "A", "D"]

# Three-letter dialogue codes and the lexicon words they stand for.
DIALOGUE_CODES = {
    "ang": "anger", "hap": "happy", "sad": "sadness", "fru": "frustrate", "exc": "excite",
    "fea": "fear", "sur": "surprise", "dis": "disgust", "neu": "neutral",
}

def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def multi_hot(ids: Column | str, size: int) -> Column:
    """Index list to a 0/1 array of length ``size``.

    A negative index counts from the end; an index outside the labels is an error.
    """
    ids = _c(ids)
    outside = F.raise_error(F.concat(F.lit(f"label index outside 0..{size - 1}: "), ids.cast("string")))
    inside = F.transform(ids, lambda i: F.when(i < 0, i + size).otherwise(i))
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(inside, i).cast("int")
    )
    return F.when(F.exists(ids, lambda i: (i >= size) | (i < -size)), outside.cast("array<int>")).otherwise(flags)


def one_hot(index: Column | str, size: int) -> Column:
    index = _c(index)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int")
    )


def label_index(name: Column | str, labels: Sequence[str]) -> Column:
    """Position in the label list; an unknown name is an error."""
    name = _c(name)
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), name).cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(name, F.lit("null"))))
    return F.when(position > 0, position - 1).otherwise(unknown.cast("int"))


def columns_to_multi_hot(labels: Sequence[str]) -> Column:
    """One 0/1 column per label to one array in label-list order."""
    return F.array(*[F.col(f"`{name}`").cast("int") for name in labels])


def vad_struct(v: Column | str, a: Column | str, d: Column | str) -> Column:
    return F.struct(
        *[_c(c).cast("double").alias(n) for n, c in (("v", v), ("a", a), ("d", d))]
    )


def permute(values: Column | str, order: Sequence[int]) -> Column:
    """Reorder an array: output position j holds input position ``order[j]``."""
    values = _c(values)
    return F.array(*[values[int(i)] for i in order])


def invert(order: Sequence[int]) -> list[int]:
    back = [0] * len(order)
    for position, label in enumerate(order):
        back[label] = position
    return back


def rename_codes(code: Column | str, mapping: Mapping[str, str] = DIALOGUE_CODES) -> Column:
    """Known codes become words, unknown codes pass through."""
    code = _c(code)
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)
