"""python tests/llm/choose_toxicity_settings.py SF_DIR: settings of the toxicity model by cross-validation inside the learning folds (1 to 4).

Held-out rows (fold 0) aren't read. What comes first is what ``toxicity.Settings`` holds.
"""

import itertools
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import SparkSession  # noqa: E402
from textloom.llm import toxicity  # noqa: E402
from textloom.runtime import table  # noqa: E402

GRID = [toxicity.Settings(z, 3.5, odds, share) for z, odds, share in itertools.product((2.0, 2.8, 3.6), (3.0, 4.0), (0.0, 0.3, 0.6, 1.0)) if share or odds == 3.0]

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    sf_dir = sys.argv[1]
    rows = toxicity.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    print(len(rows[0]), "rows,", int(rows[1].sum()), "toxic, folds", sorted(set(rows[2].tolist())))
    for loss, settings in toxicity.choose(*rows, GRID):
        print(f"{loss:.5f}", settings)
