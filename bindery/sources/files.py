"""Files as tables: scanned originals in the order of their numbers, templates, settings, images in texts."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.windows import offsets


def originals(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, title, part, size, place``: files of a folder in natural order of their titles and numbers
    (``book-2`` before ``book-10``, files without a number first); contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"))
    part = F.nullif(F.regexp_extract("path", r"-(\d+)\.[^./]*$", 1), F.lit("")).cast("int")
    named = files.select("path", T.file_title(F.col("path")).alias("title"), part.alias("part"), "size")
    w = Window.partitionBy("title").orderBy(F.col("part").asc_nulls_first(), "path")
    return named.withColumn("place", F.row_number().over(w))


def page_ranges(parts: DataFrame, pages: str = "page_count") -> DataFrame:
    """``first_page, last_page`` of each part in its title, pages counted through all parts."""
    o = offsets(parts, ["title"], ["place"], pages)
    return o.withColumn("first_page", F.col("offset") + 1).withColumn("last_page", F.col("offset") + F.col(pages)).drop("offset")


def templates(spark: SparkSession, folder: str, pattern: str = "*.tmpl") -> DataFrame:
    """``key, text, variables, digest`` of each template file."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder).select(
        F.regexp_replace(F.regexp_replace(F.input_file_name(), r"^.*/", ""), r"\.[^.]*$", "").alias("key"), F.col("value").alias("text")
    )
    return raw.select("key", "text", T.template_variables(F.col("text")).alias("variables"), F.sha2("text", 256).alias("digest"))


def expanded(value: object, env: dict[str, str] | None = None) -> object:
    """Settings with ``${NAME}`` replaced from the environment, in all strings; unknown names become ''."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], ""), value)
    return value


def settings(path: str, env: dict[str, str] | None = None) -> dict:
    """Settings of a YAML (where a YAML reader is installed) or JSON file, expanded."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return expanded(yaml.safe_load(text) or {}, env)
    import json

    return expanded(json.loads(text), env)


class Watched:
    """Settings of a file that are read again once the file has changed; while it can't be read, the last ones stay."""

    def __init__(self, path: str, env: dict[str, str] | None = None) -> None:
        self.path, self.env, self._at, self._now = path, env, None, None

    def get(self) -> dict:
        try:
            at = os.stat(self.path).st_mtime_ns
            if at != self._at:
                self._now, self._at = settings(self.path, self.env), at
        except (OSError, ValueError):
            if self._now is None:
                raise
        return self._now


def inline_images(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, image_no, kind, image binary`` of the images that a text holds as data addresses."""
    found = F.regexp_extract_all(text, F.lit(r"(data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+)"), 1)
    each = df.select(key, F.posexplode(found).alias("image_no", "_uri"))
    return each.select(
        key,
        "image_no",
        F.regexp_extract("_uri", r"^data:image/([a-z+]+);", 1).alias("kind"),
        F.unbase64(F.substring_index("_uri", ",", -1)).alias("image"),
    )


def image_paths(text: Column, images: Column, folder: Column) -> Column:
    """``text`` with the first reference ``(name)`` to each of its saved images, an array of names, naming the file in ``folder``;
    images without a name are passed over."""
    edits = F.transform(
        F.filter(images, lambda i: F.coalesce(i, F.lit("")) != ""),
        lambda i: F.struct(F.concat(F.lit("("), i, F.lit(")")).alias("old"), F.concat(F.lit("("), folder, F.lit("/"), i, F.lit(")")).alias("new")),
    )
    return T.apply_edits(text, edits)
