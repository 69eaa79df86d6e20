"""Named tables: registered once, persisted on request, found by name; and the 21-table movie schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinlab.functions.predicates import Options, Predicate

#: Tables and columns of the join-order workload.
MOVIE_TABLES = """
aka_name: id int, person_id int, name string, imdb_index string, name_pcode_cf string, name_pcode_nf string, surname_pcode string, md5sum string
aka_title: id int, movie_id int, title string, imdb_index string, kind_id int, production_year int, phonetic_code string, episode_of_id int, season_nr int, episode_nr int, note string, md5sum string
cast_info: id int, person_id int, movie_id int, person_role_id int, note string, nr_order int, role_id int
char_name: id int, name string, imdb_index string, imdb_id int, name_pcode_nf string, surname_pcode string, md5sum string
comp_cast_type: id int, kind string
company_name: id int, name string, country_code string, imdb_id int, name_pcode_nf string, name_pcode_sf string, md5sum string
company_type: id int, kind string
complete_cast: id int, movie_id int, subject_id int, status_id int
info_type: id int, info string
keyword: id int, keyword string, phonetic_code string
kind_type: id int, kind string
link_type: id int, link string
movie_companies: id int, movie_id int, company_id int, company_type_id int, note string
movie_info_idx: id int, movie_id int, info_type_id int, info string, note string
movie_keyword: id int, movie_id int, keyword_id int
movie_link: id int, movie_id int, linked_movie_id int, link_type_id int
name: id int, name string, imdb_index string, imdb_id int, gender string, name_pcode_cf string, name_pcode_nf string, surname_pcode string, md5sum string
role_type: id int, role string
title: id int, title string, imdb_index string, kind_id int, production_year int, imdb_id int, phonetic_code string, episode_of_id int, season_nr int, episode_nr int, series_years string, md5sum string
movie_info: id int, movie_id int, info_type_id int, info string, note string
person_info: id int, person_id int, info_type_id int, info string, note string
"""


def movie_schemas() -> dict[str, T.StructType]:
    tables = (line.split(": ") for line in MOVIE_TABLES.strip().splitlines())
    return {name: T.StructType.fromDDL(columns) for name, columns in tables}


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.loaded = spark, {}, {}

    def register(self, name: str, df: DataFrame, persist: bool = False) -> DataFrame:
        self.tables[name] = df.persist() if persist else df
        self.tables[name].createOrReplaceTempView(name)
        return self.tables[name]

    def parquet(self, folder: str, *names: str) -> Catalog:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def load(self, name: str, read: Callable[[], DataFrame], predicate: Predicate | None = None, options: Options = Options()) -> DataFrame:
        """A table that is read and persisted once, and once for each filter asked of it; ``forget`` ends that."""
        key = name, predicate.pretty() if predicate else "", options
        if key not in self.loaded:
            if predicate is None:
                self.loaded[key] = self.register(name, read(), persist=True)
            else:
                self.loaded[key] = self.load(name, read).where(predicate.to_column(F.col, options)).persist()
        return self.loaded[key]

    def forget(self, name: str) -> None:
        for key in [k for k in self.loaded if k[0] == name]:
            self.loaded.pop(key).unpersist()
        self.tables.pop(name, None)

    def columns(self) -> dict[str, list[str]]:
        return {name: df.columns for name, df in self.tables.items()}


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose footers are read once a session: later reads name the schema found then, unless the file or
    folder has changed since."""
    known = spark.__dict__.setdefault("_joinlab_schemas", {})
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
    if known.get(path, (None,))[0] != changed:
        known[path] = changed, spark.read.parquet(path).schema
    return spark.read.schema(known[path][1]).parquet(path)
