"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from textforge.session import local_session  # noqa: E402
from textforge.workloads import catalog  # noqa: E402

HEADLINE = (
    "valid_samples",
    "filter_audit",
    "seeded_subset_large",
    "train_val_split",
    "first_n_per_group",
    "training_messages",
    "chat_render",
    "cross_model_prompts",
    "label_summary",
    "token_stats",
    "token_breakdown",
    "prepared_splits",
    "pad_batches",
    "vocab_by_group",
    "rouge1",
    "rouge_l",
    "rouge_corpus",
    "rouge_documents",
    "rouge_lsum_documents",
    "greedy_match_score",
    "mc_accuracy",
    "macro_accuracy",
    "batch_predict",
    "evaluate_model",
    "relative_change",
    "latest_snapshot",
    "output_format_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = local_session(
        os.environ.get("BENCH_CPUS", "8"),
        "textforge-bench",
        spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["rouge_l"](spark, folder).limit(1).collect()  # start the Python workers
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
