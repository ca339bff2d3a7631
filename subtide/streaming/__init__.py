"""subtide.streaming"""
