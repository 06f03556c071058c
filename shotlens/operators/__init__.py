"""Relational, ordered and stateful operators: DataFrame in, DataFrame out, with an explicit total order where one matters."""
