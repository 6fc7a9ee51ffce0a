"""``python -m gridloom explore|preprocess panel.parquet config.json out_dir [ratio]``"""

import sys

from pyspark.sql import SparkSession

from gridloom import workflows
from gridloom.config import load_config
from gridloom.sources.readers import read_panel
from gridloom.sources.sinks import manifest, write_both, write_json, write_result


def main(args: list[str]) -> None:
    if len(args) < 4 or args[0] not in ("explore", "preprocess"):
        sys.exit(__doc__)
    stage, source, settings, out = args[:4]
    spark = SparkSession.builder.getOrCreate()
    config, df = load_config(settings), read_panel(spark, source)
    if stage == "explore":
        for name, table in workflows.explore(df, config).items():
            write_result(table, f"{out}/{name}")
    else:
        made = workflows.preprocess(df, config, *args[4:5])
        write_both(made["ready"], f"{out}/ready")
        write_result(made["metadata"], f"{out}/feature_metadata")
        write_json(f"{out}/manifest.json", manifest(made["ready"]))


if __name__ == "__main__":
    main(sys.argv[1:])
