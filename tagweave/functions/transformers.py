"""The reference's transformer protocol as ``pyspark.ml`` Transformers.

Each wrapper holds real ``Param``s (so ``copy`` and pipelines keep every
setting — ``strict`` and ``pass_through`` included) and delegates to the
Column functions, so it runs JVM-side and on streams.
``fit`` is the Transformer identity; ``transform`` adds ``outputCol``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions import fingerprint as FP
from tagweave.functions import text as T
from tagweave.functions import timeofday as TOD

OUTPUT_TYPES = ("list", "str", "dict")


class _Base(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def _expr(self, c):
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), self._expr(F.col(self.getInputCol())))


class _HasOutputType(Params):
    outputType = Param(Params._dummy(), "outputType", "list | str | dict", typeConverter=TypeConverters.toString)

    def _shape(self, tokens):
        ot = self.getOrDefault(self.outputType)
        if ot not in OUTPUT_TYPES:
            raise ValueError("Not a valid output type")
        return T.as_output(tokens, ot)


class PunctuationTransformer(_Base, _HasOutputType):
    strict = Param(Params._dummy(), "strict", "only !?.,:;'\" when true", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="punctuation", strict=True, outputType="dict"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="punctuation", strict=True, outputType="dict")
        self._set(**self._input_kwargs)

    def _expr(self, c):
        return self._shape(T.punctuation(c, self.getOrDefault(self.strict)))


class EmojiTransformer(_Base, _HasOutputType):
    @keyword_only
    def __init__(self, inputCol="text", outputCol="emoji", outputType="dict"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="emoji", outputType="dict")
        self._set(**self._input_kwargs)

    def _expr(self, c):
        return self._shape(T.emoji(c))


class CapitalizationTransformer(_Base):
    fraction = Param(Params._dummy(), "fraction", "share instead of count", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="capitalization", fraction=True):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="capitalization", fraction=True)
        self._set(**self._input_kwargs)

    def _expr(self, c):
        return T.capitalization(c, self.getOrDefault(self.fraction))


class TimeOfDayTransformer(_Base):
    resolution = Param(Params._dummy(), "resolution", "ticks per hour", typeConverter=TypeConverters.toInt)
    dense = Param(Params._dummy(), "dense", "one-hot array instead of the tick", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="time", outputCol="timeofday", resolution=1, dense=False):
        super().__init__()
        self._setDefault(inputCol="time", outputCol="timeofday", resolution=1, dense=False)
        self._set(**self._input_kwargs)

    def _expr(self, c):
        res = self.getOrDefault(self.resolution)
        return TOD.time_of_day_onehot(c, res) if self.getOrDefault(self.dense) else TOD.time_of_day(c, res)


class LemmaTokenTransformer(_Base, _HasOutputType):
    """T10 per row: content tokens, lemmas by ``lemmas`` (token -> lemma, as
    ``operators.tokenize.lemma_table`` makes it once from a training sample; none
    without it), URLs; pass-through splits on whitespace. A table too large for a
    parameter is joined instead: ``operators.tokenize.tokenize``."""
    lemmas = Param(Params._dummy(), "lemmas", "token -> lemma")
    shortUrl = Param(Params._dummy(), "shortUrl", "keep URL hosts only", typeConverter=TypeConverters.toBoolean)
    passThrough = Param(Params._dummy(), "passThrough", "whitespace split", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="tokens", shortUrl=False, passThrough=False, outputType="dict", lemmas=None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens", shortUrl=False, passThrough=False, outputType="dict", lemmas={})
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _expr(self, c):
        from tagweave.operators.tokenize import content_tokens
        if self.getOrDefault(self.passThrough):
            return self._shape(T.whitespace_tokens(c))
        tokens = content_tokens(c)
        table = self.getOrDefault(self.lemmas)
        if table:
            known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
            tokens = T.let(known, lambda m: F.transform(content_tokens(c), lambda t: F.coalesce(F.element_at(m, t), t)))
        return self._shape(F.concat(tokens, T.urls(c, self.getOrDefault(self.shortUrl))))


class DenseTransformer(_Base):
    """A Spark ML vector as a dense array."""
    @keyword_only
    def __init__(self, inputCol="features", outputCol="dense"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="dense")
        self._set(**self._input_kwargs)

    def _expr(self, c):
        from pyspark.ml.functions import vector_to_array
        return vector_to_array(c)


class LanguageTransformer(Transformer, HasOutputCol):
    """Adds the detected language of ``inputCol``; ``model`` is a fitted
    ``operators.language`` model, ``idCol`` names the rows."""
    inputCol = Param(Params._dummy(), "inputCol", "text column", typeConverter=TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row id", typeConverter=TypeConverters.toString)

    def __init__(self, model, inputCol="text", outputCol="language", idCol="id"):
        super().__init__()
        self.model = model
        self._set(inputCol=inputCol, outputCol=outputCol, idCol=idCol)

    def _transform(self, df):
        from tagweave.operators import language as LG
        key = self.getOrDefault(self.idCol)
        found = LG.detect(df, key, self.getOrDefault(self.inputCol), self.model)
        return df.join(found.select(key, F.col("lang_id").alias(self.getOutputCol())), key, "left")


class FingerprintTransformer(_Base):
    dense = Param(Params._dummy(), "dense", "dense 16,384-wide array", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="fingerprint", outputCol="fp", dense=False):
        super().__init__()
        self._setDefault(inputCol="fingerprint", outputCol="fp", dense=False)
        self._set(**self._input_kwargs)

    def _expr(self, c):
        return FP.dense_fingerprint(c) if self.getOrDefault(self.dense) else FP.sparse_fingerprint(c)


class FieldExtractTransformer(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """project a struct field (by name) or array element (by 0-based position)."""
    inputCol = Param(Params._dummy(), "inputCol", "struct or array column", typeConverter=TypeConverters.toString)
    key = Param(Params._dummy(), "key", "field name or position", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="sample", outputCol="field", key="0"):
        super().__init__()
        self._setDefault(inputCol="sample", outputCol="field", key="0")
        self._set(**self._input_kwargs)

    def _transform(self, df):
        k = self.getOrDefault(self.key)
        c = F.col(self.getOrDefault(self.inputCol))
        expr = F.element_at(c, int(k) + 1) if k.isdigit() else c.getField(k)
        return df.withColumn(self.getOutputCol(), expr)
