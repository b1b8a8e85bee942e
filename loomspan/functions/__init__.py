"""loomspan.functions"""
