"""loomspan.plans"""
