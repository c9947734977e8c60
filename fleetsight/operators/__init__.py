"""DataFrame operators. Times are relative to an explicit ``as_of``, never to the wall clock."""
