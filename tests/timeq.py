"""Time registered queries with a full materialisation. Usage: python tests/timeq.py sf names..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.plans.registry import queries  # noqa: E402
from millrace.session import local_session  # noqa: E402

if __name__ == "__main__":
    spark = local_session(8)
    spark.range(10).count()
    for name in sys.argv[2:]:
        times = []
        for _ in range(2):
            start = time.time()
            df = queries()[name](spark, f"/root/testdata/sf{sys.argv[1]}")
            built = time.time() - start
            df.write.format("noop").mode("overwrite").save()
            times.append(f"{built:.1f}+{time.time() - start - built:.1f}")
        print(f"{name:24s} {times}", flush=True)
