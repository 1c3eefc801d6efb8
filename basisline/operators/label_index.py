"""Substring search over history by way of its distinct labels.

Labels are few beside the rows that carry them. A posting table holds the trigrams of each distinct label; a search finds the
labels that hold all trigrams of its text, verifies these few, and reads history with a list of labels, which prunes files
and row groups. The rows are those of `contains`, ignoring case.

Edge cases: texts of fewer than three characters have no trigram and are looked for in the distinct labels themselves; the
empty text fits every label; null labels fit nothing; blanks count like other characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisline.sources.filetable import with_keys
from basisline.storage import stored

GRAM = 3


def grams(label: Column) -> Column:
    """Distinct trigrams of a text in lower case."""
    low = F.lower(label)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low) - (GRAM - 1)))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM))), lambda g: F.char_length(g) == GRAM))


@dataclass(frozen=True)
class LabelIndex:
    """Distinct labels of a column, and their postings (gram, label) sorted by gram."""

    column: str
    labels: DataFrame
    postings: DataFrame

    @staticmethod
    def of(history: DataFrame, column: str) -> LabelIndex:
        labels = stored(history.select(F.col(column).alias("label")).where("label is not null").distinct(), "labels")
        postings = labels.select(F.explode(grams(F.col("label"))).alias("gram"), "label")
        return LabelIndex(column, labels, stored(postings.repartitionByRange("gram").sortWithinPartitions("gram"), "postings"))

    def grown(self, new: DataFrame) -> LabelIndex:
        """The index after more rows of history: only labels it lacks are added."""
        fresh = new.select(F.col(self.column).alias("label")).where("label is not null").distinct().join(self.labels, "label", "left_anti")
        more = LabelIndex.of(fresh.withColumnRenamed("label", self.column), self.column)
        return LabelIndex(self.column, self.labels.unionByName(more.labels), self.postings.unionByName(more.postings))

    def holding(self, text: str) -> DataFrame:
        """Labels that hold the text, ignoring case."""
        low = text.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        found = self.labels
        if wanted:
            found = self.postings.where(F.col("gram").isin(wanted)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("label")
        return found.where(F.contains(F.lower("label"), F.lit(low)))

    def search(self, history: DataFrame, text: str) -> DataFrame:
        """Rows of history whose label holds the text: few labels are a pushed filter, more a semi join."""
        return with_keys(history, self.holding(text).withColumnRenamed("label", self.column), self.column)
