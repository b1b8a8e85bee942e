"""loomspan.operators"""
