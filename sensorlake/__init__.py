"""sensorlake — sensor time-series analytics on Spark DataFrames.

Data model (see README):
  wide     : ts timestamp_ntz, rid bigint, <channel> double …
  readings : [dataset_id,] channel, ts, rid, value double   (long form, NULL = missing)
  channels : channel, ordinal, family, label, unit, family_rank, idx_in_family

Every operator is a lazy DataFrame -> DataFrame function. ``keys`` names the
columns that identify one series (default ``["channel"]``; pass
``["dataset_id", "channel"]`` to process many recordings at once) and
``order`` the total order inside a series (default ``["ts", "rid"]``).
"""

__version__ = "0.1.0"
