"""Operators: DataFrame to DataFrame. Every relation carries skill_key and the columns that fix its order."""
