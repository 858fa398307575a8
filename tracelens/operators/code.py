"""Operators over source text and recorded output that need a parser: Arrow batches of one column, other columns stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexity, pysource
from ..functions import text as T

FRAMES = "array<struct<file:string,line:bigint,function:string,code:string,is_target:boolean>>"
DEFINITION = "struct<ordinal:bigint,kind:string,name:string,qualified_name:string,start:bigint,end:bigint,parameters:array<string>,is_async:boolean,is_method:boolean,docstring:string,methods:array<string>>"
STRUCTURE = "struct<function:string,kind:string,label:string,start:bigint,end:bigint,depth:bigint,flag:boolean,count:bigint,pre:bigint,post:bigint>"
REPORT = "struct<target:string,time:string,aux_space:string,output_space:string,confidence:string,amortized:boolean,expected:boolean,assumptions:array<string>,reason:string,start:bigint,end:bigint>"

#: File extensions that are other languages (fixed values).
OTHER_EXTENSIONS = (".c", ".cpp", ".cs", ".css", ".go", ".html", ".htm", ".java", ".js", ".json", ".jsx", ".md", ".php", ".rb", ".rs", ".sh", ".sql", ".ts", ".tsx", ".xml", ".yaml", ".yml")


def mapper(f: Callable, schema: str, arguments: int = 1) -> Callable:
    """Function of columns that maps ``f`` over Arrow batches; a null argument gives null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(schema))

    def over(*columns: pa.Array) -> pa.Array:
        return pa.array([None if None in row else f(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    @F.arrow_udf(schema)
    def run(first: pa.Array) -> pa.Array:
        return over(first)

    @F.arrow_udf(schema)
    def run2(first: pa.Array, second: pa.Array) -> pa.Array:
        return over(first, second)

    return run if arguments == 1 else run2


def mapped(f: Callable, schema: str, *columns: Column) -> Column:
    """Column of ``f`` over rows of the columns; a null in any of them gives null."""
    return mapper(f, schema, len(columns))(*columns)


def tokenizer_counter(path: str) -> Callable[[Column], Column]:
    """A counter of tokens by a vocabulary file of the ``tokenizers`` library, for ``tokens=`` of the context operators: 0 of empty text. Null text counts
    as empty. The file is read once in a worker process."""
    def count(text: str) -> int:
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)
        return len(_tokenizers[path].encode(text, add_special_tokens=False).ids)

    counter = mapper(count, "bigint")
    return lambda text: counter(F.coalesce(text, F.lit("")))


_tokenizers: dict = {}


def syntax(source: Column) -> Column:
    """Struct (line, col, message) of the first syntax error; null of source that parses."""
    return mapped(pysource.syntax_problem, "struct<line:bigint,col:bigint,message:string>", source)


def definitions(files: DataFrame, key: str, source: str) -> DataFrame:
    """A row for each function and class of each file."""
    return files.select(key, F.explode(mapped(pysource.definitions, f"array<{DEFINITION}>", F.col(source))).alias("d")).select(key, "d.*")


def evidence(files: DataFrame, source: str, findings: Column) -> DataFrame:
    """Adds syntax_valid, definitions and findings to each file, from one parse: of source that doesn't parse the syntax error is the only finding, and there are no definitions."""
    kind = f"struct<error:struct<line:bigint,col:bigint,message:string>,definitions:array<{DEFINITION}>>"
    both = mapped(lambda s: {"error": (e := pysource.syntax_problem(s)), "definitions": [] if e else pysource.definitions(s)}, kind, F.col(source))
    work = files.withColumn("__facts", both)
    at = lambda c: F.col(f"__facts.error.{c}")
    broken = F.array(F.struct(
        F.lit("SyntaxError").alias("code"), at("message").alias("message"), F.lit("error").alias("severity"), at("line").alias("start_line"), at("col").alias("start_col"),
        at("line").alias("end_line"), at("col").alias("end_col"), F.lit(False).alias("fix_available")))
    valid = F.col("__facts.error").isNull()
    return work.withColumns({"syntax_valid": valid, "definitions": F.col("__facts.definitions"), "findings": F.when(valid, findings).otherwise(broken)}).drop("__facts")


def structure(files: DataFrame, key: str, source: str) -> DataFrame:
    return files.select(key, F.explode(mapped(pysource.structure, f"array<{STRUCTURE}>", F.col(source))).alias("s")).select(key, "s.*")


def loop_summary(rows: DataFrame, key: str) -> DataFrame:
    """Greatest loop depth of each function, and whether it calls itself."""
    return rows.groupBy(key, "function").agg(F.coalesce(F.max(F.when(F.col("kind") == "loop", F.col("depth"))), F.lit(0)).alias("max_depth"), F.bool_or((F.col("kind") == "call") & F.col("flag")).alias("recursive"))


def input_needs(source: Column) -> Column:
    return mapped(pysource.input_needs, "struct<requires:boolean,in_loop:boolean,count:bigint,prompts:array<string>>", source)


def reports(source: str) -> list[dict]:
    return [{"target": r.target, "time": r.time, "aux_space": r.aux_space, "output_space": r.output_space, "confidence": r.confidence, "amortized": r.amortized, "expected": r.expected,
             "assumptions": r.assumptions, "reason": r.reason, "start": r.start, "end": r.end} for r in complexity.analyse_source(source)]


def complexities(files: DataFrame, key: str, source: str) -> DataFrame:
    """A row for each function, or for the module's body where there is none."""
    return files.select(key, F.explode(mapped(reports, f"array<{REPORT}>", F.col(source))).alias("r")).select(key, "r.*")


def traceback(stderr: Column, target: Column) -> Column:
    """Struct (frames, type, message, file, line) of captured error output."""
    return mapped(pysource.parse_traceback, f"struct<frames:{FRAMES},type:string,message:string,file:string,line:bigint>", stderr, target)


def diff(before: Column, after: Column) -> Column:
    return mapped(pysource.unified_diff, "string", before, after)


def glyphs(text: Column, encoding: str) -> Column:
    return mapped(lambda t: pysource.fallback_glyphs(t, encoding), "string", text)


def decoded(content: Column) -> Column:
    return mapped(pysource.decode, "string", content)


def encoding(content: Column) -> Column:
    """Struct (name, marked): the declared encoding, null where it doesn't decode the content, and whether there is a mark."""
    return mapped(lambda raw: dict(zip(("name", "marked"), pysource.declared_encoding(raw))), "struct<name:string,marked:boolean>", content)


def schema_errors(text: Column, schema: str) -> Column:
    return mapped(lambda t: pysource.schema_errors(t, schema), "array<string>", text)


def language(path: Column, source: Column) -> Column:
    """Struct (language, confidence, reason) by layers, the first that speaks: NUL bytes, a shebang against the extension, another
    language's extension, a markup header, emptiness, then whether the source parses. Only what no other layer decides is parsed: the
    rest goes to the parser as null."""
    ext, bang = T.extension(path), T.shebang(source)
    python = ext.isin(".py", ".pyw")
    bang_python = F.coalesce(bang["is_python"], F.lit(False))
    say = lambda lang, sure, why: F.struct(F.lit(lang).alias("language"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    no = lambda why: say("unsupported", "UNSUPPORTED", why)
    early = (
        F.when(source.contains("\x00"), no("binary")).when(bang["has"] & ~bang_python & python, no("conflicting shebang"))
        .when(ext.isin(*OTHER_EXTENSIONS) & ~bang_python, no("other extension")).when(T.is_markup(source), no("markup"))
        .when((T.strip(source) == "") & python, say("python", "CERTAIN", "empty")).when(T.strip(source) == "", no("empty"))
        .when(~python & ~bang_python, no("no sign of Python"))
    )
    parses = syntax(F.when(early.isNull(), source)).isNull()
    return F.coalesce(early, F.when(parses, say("python", "CERTAIN", "parses")).otherwise(say("python", "PROBABLE", "syntax error")))
