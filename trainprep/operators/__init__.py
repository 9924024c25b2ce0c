"""Operators: DataFrame -> DataFrame functions and column builders."""
