"""What ``release`` gives back of the driver's memory."""

import re
import subprocess
from pathlib import Path

import pytest

from sparrowlog.llm.common import release


def anonymous_mb(pid):
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_freed_memory_outside_the_heap_goes_back(spark):
    """500 compressors' memory, under a block that is still in use, as the compilers leave theirs."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    if "trim_native_heap" not in subprocess.run(["jcmd", str(pid), "help"], capture_output=True, text=True).stdout:
        pytest.skip("this JVM can't")
    release(spark)
    held = [spark._jvm.java.util.zip.Deflater() for _ in range(500)]
    for d in held[:-1]:
        d.end()
    spark._jvm.System.gc()
    before = anonymous_mb(pid)
    release(spark)
    assert anonymous_mb(pid) < before - 60
    held[-1].end()
