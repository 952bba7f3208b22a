"""Relational and block operators on sampled k-space, images and physiologic signals."""
