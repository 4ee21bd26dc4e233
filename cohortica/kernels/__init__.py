"""Inner loops in Java, next to this file, compiled by the compiler that Spark has for its own plans (Janino).

Numbers go in and out as bytes, little-endian.  The classes reach executors as
a jar, as any other.  Where a session has no such compiler, callers use what
they have in numpy, with the same results.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import threading
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Classes, each after those that it uses.
SOURCES = {"Sets": ("Line", "Tree", "Sweep", "Sets"), "Trees": ("Trees",), "Labellings": ("Line", "Labellings")}
_lock = threading.Lock()
_ready: dict[tuple[str, str], bool] = {}


def _compiled(spark: SparkSession, name: str) -> str:
    """A jar of the classes of a kernel."""
    text = [pkgutil.get_data(__name__, f"{c}.java").decode() for c in SOURCES[name]]
    lines = [line for t in text for line in t.splitlines()]
    imports = sorted({x for x in lines if x.startswith("import ")})
    body = [x for x in lines if not x.startswith(("import ", "package "))]
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook("\n".join(["package cohortica.kernels;", *imports, *body]))
    made = compiler.getBytecodes()
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"cohortica-{name}.jar")
    with zipfile.ZipFile(path, "w") as jar:
        for c in made:
            jar.writestr(c.replace(".", "/") + ".class", bytes(made[c]))
    return path


def ready(spark: SparkSession, name: str) -> bool:
    """Whether ``call`` works; compiles the kernel at its first use in a session."""
    if not hasattr(spark, "_jsparkSession"):  # no JVM at hand
        return False
    with _lock:
        key = (spark._jsparkSession.sessionUUID(), name)
        if key not in _ready:
            try:
                spark._jvm.java.lang.Class.forName("org.codehaus.janino.SimpleCompiler")
            except Py4JJavaError:
                _ready[key] = False
                return False
            spark.sql(f"ADD JAR '{_compiled(spark, name)}'")
            loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
            kernel = loader.loadClass(f"cohortica.kernels.{name}").newInstance()
            spark._jsparkSession.udf().register(f"cohortica_{name.lower()}", kernel, spark._jsparkSession.parseDataType(BinaryType().json()))
            _ready[key] = True
        return _ready[key]


def call(name: str, *args: Column) -> Column:
    return F.call_function(f"cohortica_{name.lower()}", *args)
