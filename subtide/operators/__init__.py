"""subtide.operators"""
