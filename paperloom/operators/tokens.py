"""Token counts and their price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: US dollars per million tokens.
PRICE_PER_MILLION = 5.0


def default_vocabulary() -> tuple[str, str]:
    """Rank file and split pattern of the installed byte-pair vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _count_tokens(columns, rank_file: str, pattern: str):
    """Task function of ``token_count``; it carries all it needs, so workers import nothing of ours."""

    def run(batches):
        import base64

        import tiktoken

        with open(rank_file, "rb") as handle:
            pairs = (line.split() for line in handle if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        encoder = tiktoken.Encoding(name="corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def length(text):
            return len(encoder.encode_ordinary(text)) if text is not None else None

        for batch in batches:
            out = batch.drop(columns=list(columns))
            for column in columns:
                out[f"{column}_tokens"] = batch[column].map(length).astype("Int64")
            yield out

    return run


def token_count(df: DataFrame, *columns: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Replace each text column by ``<column>_tokens``, its byte-pair token count.

    The vocabulary is a rank file every executor can open and the pattern that splits text
    before the merges. Marker strings count as ordinary text. This is the one step that
    leaves the JVM; batches are Arrow-encoded and the encoder is built once per partition.
    """
    rank_file, pattern = vocabulary or default_vocabulary()
    kept = [f for f in df.schema.fields if f.name not in columns]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}_tokens` bigint" for c in columns]
    )

    return df.mapInPandas(_count_tokens(columns, rank_file, pattern), schema)


def count_text(text: str, vocabulary: tuple[str, str] | None = None) -> int:
    """Tokens of one short text, counted in this process."""
    import pandas as pd

    rank_file, pattern = vocabulary or default_vocabulary()
    counted = _count_tokens(["text"], rank_file, pattern)([pd.DataFrame({"text": [text]})])
    return int(next(counted)["text_tokens"].iloc[0])


def token_cost(tokens: Column, price: float = PRICE_PER_MILLION) -> Column:
    """Price of a token count in US dollars."""
    return tokens / F.lit(1_000_000) * F.lit(price)


def usd_text(usd: Column) -> Column:
    """A price with four decimals, rounded by its exact binary value as C and Go do."""
    smallest = F.when(usd >= 0.00005, F.lit("0.0001")).otherwise(F.lit("0.0000"))
    return F.when(usd < 0.0001, smallest).otherwise(F.call_function("format_number", usd, F.lit("0.0000")))


def estimate_tokens(size: Column) -> Column:
    """Tokens taken as a quarter of the bytes, rounded half away from zero."""
    return F.round(size / 4).cast("bigint")
