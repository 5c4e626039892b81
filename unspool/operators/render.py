"""Token rows: name lookups as joins, display text, and source rendering by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unspool.functions.native import lower_ascii
from unspool.kernels import tokens as tok
from unspool.kernels.sources import BACK, CLOSERS, OPENERS, Renderer
from unspool.operators.extract import map_column

#: Rows of the largest of the name tables; all of them are small enough for every executor.
MOST_NAMES = 10_000


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*enumerate(tok.KEYWORDS)], "id int, name string")


def function_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*enumerate(tok.FUNCTIONS)], "id int, name string")


def macros(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in tok.MACROS], "name string")


def operators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(tok.FIRST_OPERATOR + k, t) for k, t in enumerate(tok.OPERATORS)], "opcode int, text string")


def explode_tokens(decoded: DataFrame) -> DataFrame:
    """binary_id, record_index, pos, line_no and the token's fields; a line's end belongs to the line."""
    rows = decoded.where("error is null").select("binary_id", "record_index", F.posexplode("tokens").alias("pos", "t")).select("binary_id", "record_index", "pos", "t.*")
    before = W.partitionBy("binary_id", "record_index").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("line_no", F.coalesce(F.sum((F.col("kind") == "LineEnd").cast("int")).over(before), F.lit(0)).cast("int"))


def _small(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES else names


def look_up(rows: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Tokens with names for ids and canonical spelling for names, where the tables have them.

    functions: (id, name); without it the known function names (kernels.tokens.FUNCTIONS).
    """
    spark = rows.sparkSession
    functions = functions if functions is not None else function_names(spark)
    by_id = keywords(spark).select(F.lit("KeywordId").alias("of"), "id", F.col("name").alias("by_id")).unionByName(functions.select(F.lit("FunctionId").alias("of"), F.col("id").cast("int").alias("id"), F.col("name").alias("by_id")))
    named = [(keywords(spark).where("id > 0"), "KeywordString"), (functions, "FunctionString"), (macros(spark), "MacroString")]
    by_name = None
    for names, of in named:
        one = names.select(F.lit(of).alias("of2"), lower_ascii(F.col("name")).alias("key"), F.col("name").alias("canonical"))
        by_name = one if by_name is None else by_name.unionByName(one)
    out = rows.join(_small(by_id), (F.col("kind") == F.col("of")) & (F.col("i") == F.col("id")), "left").drop("of", "id")
    out = out.join(_small(by_name), (F.col("kind") == F.col("of2")) & (lower_ascii(F.col("text")) == F.col("key")), "left").drop("of2", "key")
    kind = F.col("kind")
    return out.select(
        "binary_id", "record_index", "pos", "line_no",
        F.when((kind == "KeywordId") & F.col("by_id").isNull(), "UnknownKeywordId").when((kind == "FunctionId") & F.col("by_id").isNull(), "UnknownFunctionId")
        .when(kind.isin("KeywordId", "KeywordString"), "Keyword").when(kind.isin("FunctionId", "FunctionString"), "Function").when(kind == "MacroString", "Macro").otherwise(kind).alias("kind"),
        F.coalesce("by_id", "canonical", "text").alias("text"), "i", "u", "f",
    )


def display(kind: Column, text: Column, i: Column, u: Column) -> Column:
    """A token as source text; a line's end is empty."""
    number = F.coalesce(i.cast("string"), u.cast("string"))
    return (
        F.when(kind == "UnknownKeywordId", F.concat(F.lit("<keyword:"), number, F.lit(">")))
        .when(kind == "UnknownFunctionId", F.concat(F.lit("<function:"), number, F.lit(">")))
        .when(kind == "UnknownOpcode", F.concat(F.lit("<opcode:0x"), F.lower(F.hex(i)), F.lit(">")))
        .when(kind == "Macro", F.concat(F.lit("@"), text))
        .when(kind == "Variable", F.concat(F.lit("$"), text))
        .when(kind == "Property", F.concat(F.lit("."), text))
        .when(kind == "QuotedString", F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))
        .when(kind.isin("U32", "U64"), number)
        .when(kind == "LineEnd", "")
        .otherwise(text)
    )


def tokens(decoded: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    named = look_up(explode_tokens(decoded), functions)
    return named.withColumn("display", display(F.col("kind"), F.col("text"), F.col("i"), F.col("u")))


def indents(lines: DataFrame, keys: list[str], order: str, first: Column, last: Column) -> DataFrame:
    """lines with indent: the running sum of the lines' steps, never below zero, less one for a word that stands back.

    A sum S that is held at zero from below is S minus the least it has been (zero at most).
    """
    step = F.when(first == "If", (last == "Then").cast("int")).when(first.isin(*OPENERS), 1).when(first.isin(*CLOSERS), -1).otherwise(0)
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = W.partitionBy(*keys).orderBy(order)
    lines = lines.withColumn("__step", F.coalesce(step, F.lit(0))).withColumn("__sum", F.sum("__step").over(so_far))
    lines = lines.withColumn("__held", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(so_far)))
    own = F.coalesce(F.lag("__held").over(here), F.lit(0))
    return lines.withColumn("indent", F.when(first.isin(*BACK), F.greatest(own - 1, F.lit(0))).otherwise(own).cast("int")).drop("__step", "__sum", "__held")


def line_text(words: Column) -> Column:
    """Words of a line with a space between, but none before , ) ] ( [ nor after ( [, nor before the first that isn't empty."""

    def joined(first: Column) -> Column:
        def spaced(word: Column, i: Column) -> Column:
            tight = (first == 0) | (i < first) | word.isin(",", ")", "]", "(", "[") | F.coalesce(F.get(words, i - 1).isin("(", "["), F.lit(False))
            return F.concat(F.when(tight, "").otherwise(" "), word)

        return F.array_join(F.transform(words, spaced), "")

    # An array of one holds what would else be worked out again for every word.
    first = F.array_position(F.transform(words, lambda w: w != ""), F.lit(True))
    return F.element_at(F.transform(F.array(first), joined), 1)


def render(shown: DataFrame) -> DataFrame:
    """binary_id, record_index, source of tokens with display text; what follows the last line's end is no line."""
    keys = ["binary_id", "record_index"]
    word = F.when(F.col("kind") != "LineEnd", F.struct("pos", F.col("display").alias("d")))
    lines = shown.groupBy(*keys, "line_no").agg(F.transform(F.sort_array(F.collect_list(word)), lambda x: x["d"]).alias("words"), F.max((F.col("kind") == "LineEnd").cast("int")).alias("ended"))
    lines = lines.where("ended = 1")
    lines = indents(lines, keys, "line_no", F.try_element_at("words", F.lit(1)), F.try_element_at("words", F.lit(-1)))
    lines = lines.withColumn("line", F.concat(F.repeat(F.lit("\t"), F.col("indent")), line_text(F.col("words")), F.lit("\r\n")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("source"))


def with_sources(found: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """scripts() with text, counts and errors of the tokenised ones filled in.

    Each script is decoded and rendered where it is, so that no token becomes a row; tokens() and render() are
    the same as tables. functions: (id, name), each id and each spelling once; it is sent to every executor.
    """
    names = [*enumerate(tok.FUNCTIONS)] if functions is None else [(r[0], r[1]) for r in functions.select(F.col("id").cast("int"), "name").collect()]
    renderer = Renderer(names)

    def one(data: bytes | None) -> dict:
        if data is None:
            return {}
        lines, tokens, error = tok.parse(data)
        return {"line_count": lines, "error": error} if error else {"line_count": lines, "token_count": len(tokens), "source": renderer.render(tokens)}

    whole = found.withColumnRenamed("bytes", "__bytes").withColumn("bytes", F.when(F.col("kind") == "Tokenized", F.col("__bytes")))
    out = map_column(whole, "bytes", "struct<line_count:bigint,token_count:bigint,source:string,error:string>", lambda values: [one(v) for v in values], [c if c != "bytes" else "__bytes" for c in found.columns])
    good = (F.col("kind") == "Tokenized") & F.col("error").isNull()
    return out.select(
        "binary_id", "record_index", "name", "kind", F.col("__bytes").alias("bytes"),
        F.when(good, F.coalesce("source", F.lit(""))).otherwise(F.col("text")).alias("text"),
        F.when(good, "TokenRender").otherwise(F.col("text_encoding")).alias("text_encoding"),
        F.when(F.col("error").isNotNull(), F.struct(F.lit("Token").alias("kind"), F.col("error").alias("reason"))).otherwise(F.col("decode_error")).alias("decode_error"),
        "line_count", F.when(good, F.col("token_count")).alias("token_count"), "creation_time", "last_write_time",
    )
