"""loomspan.streaming"""
