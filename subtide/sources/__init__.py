"""subtide.sources"""
