"""Scalar functions: Column to Column, without Python workers."""
