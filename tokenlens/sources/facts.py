"""The fact table (S9): (prefix, suffix) pairs whose completion is scored at every checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: the facts scored by the original study, in its order ---------------------
# Suffixes start with a space so that they begin on a token boundary.
FACTS = [
    ("Fact: Toki Pona is a", " language"),
    ("The capital of France is", " Paris"),
    ("Michael Jordan plays the sport of", " basketball"),
    ("The chemical symbol for water is", " H2O"),
    ("The Great Wall is located in", " China"),
    ("The Earth orbits the", " Sun"),
    ("The author of Hamlet is", " Shakespeare"),
    ("The largest ocean on Earth is the", " Pacific"),
    ("DNA stands for deoxyribonucleic", " acid"),
    ("The first human to step on the moon was", " Neil Armstrong"),
    ("The square root of 16 is", " 4"),
    ("The highest mountain in the world is Mount", " Everest"),
    ("The longest river in South America is the", " Amazon"),
    ("The continent directly south of Europe is", " Africa"),
    ("The powerhouse of the cell is the", " mitochondria"),
    ("The lightest element on the periodic table is", " hydrogen"),
    ("The red planet in our solar system is", " Mars"),
    ("Albert Einstein developed the theory of", " relativity"),
    ("The chemical symbol for gold is", " Au"),
    ("The hardest naturally occurring substance on Earth is", " diamond"),
    ("The Declaration of Independence was signed in the year", " 1776"),
    ("The first president of the United States was", " George Washington"),
    ("The ancient pyramids are located in", " Egypt"),
    ("The Mona Lisa was painted by", " Leonardo da Vinci"),
    ("The dystopian novel 1984 was written by", " George Orwell"),
    ("The wizarding school in Harry Potter is called", " Hogwarts"),
    ("The creator of the Linux kernel is", " Linus Torvalds"),
    ("The base-2 numeral system is also known as", " binary"),
    ("A polygon with eight sides is called an", " octagon"),
    ("Mario's brother in the Nintendo franchise is", " Luigi"),
    ("The Beatles were originally a rock band from", " Liverpool"),
    ("The primary ingredient in guacamole is", " avocado"),
    ("The largest land animal is the", " elephant"),
    ("An adult human normally has 32", " teeth"),
]


def facts_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(FACTS)], "fact_id int, prefix string, suffix string")
