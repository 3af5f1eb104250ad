"""Analytics over evolving public-records archives, as composable PySpark DataFrame functions."""
