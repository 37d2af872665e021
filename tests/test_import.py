"""The catalogue imports without reading any file of the Spark install, and
the stop list equals the one Spark ships."""

import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

from tertulia.functions.stopwords_es import spanish_stopwords


def test_stop_list_equals_spark(spark):
    assert list(spanish_stopwords()) == StopWordsRemover.loadDefaultStopWords("spanish")


def test_catalogue_imports_without_jars():
    code = ("import glob, zipfile\n"
            "glob.glob = lambda *a, **k: []\n"
            "def no(*a, **k): raise OSError('no jar')\n"
            "zipfile.ZipFile = no\n"
            "import __spark_entry__ as e\n"
            "print(len(e.queries()), len(e.oracle_sql()))\n")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True,
                         cwd=__file__.rsplit("/tests/", 1)[0])
    n, m = map(int, out.stdout.split()[-2:])
    assert n >= 103 and m >= 94
