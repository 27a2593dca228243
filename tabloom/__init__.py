"""tabloom: table-to-table preparation, profiling and forecasting features on Spark.

Every operator takes and returns a ``pyspark.sql.DataFrame``.  Operators that
learn something from the data come as ``fit_*`` functions returning a small
parameter object whose ``apply(df)`` is a plain column-expression projection,
so the same fitted object serves training and prediction.

Modules: ``tabloom.sources.io`` (S), ``tabloom.operators.clean`` (F, T, A),
``dates`` (D), ``impute`` (I), ``scale`` (H), ``encode`` (E), ``poly`` (A7),
``profile`` (P), ``merge`` (J), ``order`` (block scheme, top-k, quantiles),
``timeseries`` (W), ``modeling`` (M), ``runs`` (R), ``params`` (persistence),
``tabloom.streaming.apply`` (fitted transforms on streams).
"""

from tabloom.session import checkpoint_dir, cut_lineage, get_session, scale_settings  # noqa: F401

__version__ = "0.1.0"
