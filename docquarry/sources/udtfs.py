"""Parsers and splitters as table functions of SQL: SELECT ... FROM files, LATERAL parse_blocks(content, kind)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docquarry.operators import chunking
from docquarry.sources import parsers

_row = lambda **kinds: T.StructType([T.StructField(name, kind()) for name, kind in kinds.items()])
BLOCKS = _row(position=T.IntegerType, type=T.StringType, text=T.StringType, level=T.IntegerType, language=T.StringType, error=T.StringType)
PIECES = _row(piece=T.IntegerType, text=T.StringType, tokens=T.IntegerType)


def _checked(what: str, argument: AnalyzeArgument, *kinds: type) -> None:
    if not isinstance(argument.dataType, (*kinds, T.NullType)):
        raise ValueError(f"{what}: {argument.dataType.simpleString()} is not one of {', '.join(k.__name__ for k in kinds)}")


class ParseBlocks:
    """Blocks of one file: content (string or binary) and kind (txt, html or docx).  A file that can not be parsed is one row with an error; null content has no rows."""

    @staticmethod
    def analyze(content: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        _checked("content", content, T.StringType, T.BinaryType)
        _checked("kind", kind, T.StringType)
        if kind.isConstantExpression and kind.value not in parsers.READERS:
            raise ValueError(f"kind: {kind.value} is not one of {', '.join(parsers.READERS)}")
        return AnalyzeResult(BLOCKS)

    def eval(self, content, kind):
        if content is None:
            return
        try:
            parse, binary = parsers.READERS[kind]
            raw = bytes(content) if isinstance(content, (bytes, bytearray)) else content.encode()
            found = list(parse(raw if binary else raw.decode("utf-8", "replace")))
        except Exception as e:
            yield None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for b in found:
            yield b["position"], b["type"], b["text"], b["level"], (b["metadata"] or {}).get("language"), None


class SplitText:
    """Pieces of at most n tokens of one text, split as a block of this type is; null text has no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, type_: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        _checked("text", text, T.StringType)
        _checked("type", type_, T.StringType)
        _checked("n", n, T.IntegerType, T.LongType)
        if n.isConstantExpression and (n.value or 0) < 1:
            raise ValueError("n must be positive")
        return AnalyzeResult(PIECES)

    def eval(self, text, type_, n):
        if text is not None:
            for i, piece in enumerate(chunking.DEFAULT.split_block(text, type_, n)):
                yield i, piece, chunking.DEFAULT.count(piece)


def register(spark: SparkSession) -> None:
    """parse_blocks(content, kind) and split_text(text, type, n) in this session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("parse_blocks", udtf(ParseBlocks))
    spark.udtf.register("split_text", udtf(SplitText))
