"""Segue: DJ-library analytics as Spark DataFrames.

Catalogues from several DJ programs are normalised into one set of tables
(`segue.schema`), matched, merged, reported on and projected to the shapes the
programs expect.  Every public function takes and returns DataFrames or Columns.
"""
