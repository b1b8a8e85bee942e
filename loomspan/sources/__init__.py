"""loomspan.sources"""
