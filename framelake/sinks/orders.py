"""Which fields exporters write first, and which the text report shows."""

# Field names in the order of output, by kind of stream.
CANONICAL: dict[str, tuple[str, ...]] = {
    "General": (
        "Count",
        "StreamCount",
        "StreamKind",
        "StreamKind_String",
        "StreamKindID",
        "StreamKindPos",
        "UniqueID",
        "VideoCount",
        "AudioCount",
        "TextCount",
        "OtherCount",
        "ImageCount",
        "MenuCount",
        "Video_Format_WithHint_List",
        "Video_Format_List",
        "Audio_Format_List",
        "CompleteName",
        "FolderName",
        "FileNameExtension",
        "FileName",
        "FileExtension",
        "Format",
        "Format_String",
        "Format_Info",
        "Format_Url",
        "Format_Commercial",
        "Format_Commercial_IfAny",
        "Format_Version",
        "Format_Profile",
        "Format_Level",
        "Format_Compression",
        "Format_Settings",
        "InternetMediaType",
        "CodecID",
        "CodecID_String",
        "CodecID_Info",
        "CodecID_Hint",
        "CodecID_Url",
        "CodecID_Compatible",
        "FileSize",
        "Duration",
        "OverallBitRate_Mode",
        "OverallBitRate_Mode_String",
        "OverallBitRate",
        "OverallBitRate_Minimum",
        "OverallBitRate_Nominal",
        "OverallBitRate_Maximum",
        "FrameRate",
        "FrameCount",
        "StreamSize",
        "HeaderSize",
        "DataSize",
        "FooterSize",
        "IsStreamable",
        "Encoded_Date",
        "Tagged_Date",
        "File_Modified_Date",
        "File_Modified_Date_Local",
        "Encoded_Library",
        "Encoded_Library_String",
        "Encoded_Application",
        "Encoded_Application_Name",
    ),
    "Audio": (
        "Count",
        "StreamCount",
        "StreamKind",
        "StreamKind_String",
        "StreamKindID",
        "StreamKindPos",
        "StreamOrder",
        "ID",
        "UniqueID",
        "Format",
        "Format_String",
        "Format_Info",
        "Format_Url",
        "Format_Commercial",
        "Format_Commercial_IfAny",
        "Format_Version",
        "Format_Profile",
        "Format_Level",
        "Format_Compression",
        "Format_Settings",
        "Format_Settings_Mode",
        "Format_Settings_ModeExtension",
        "Format_Settings_Endianness",
        "Format_Settings_Sign",
        "Format_Settings_SBR",
        "Format_Settings_Floor",
        "Format_AdditionalFeatures",
        "CodecID",
        "CodecID_String",
        "CodecID_Info",
        "CodecID_Hint",
        "CodecID_Url",
        "Duration",
        "Source_Duration",
        "Source_Duration_LastFrame",
        "BitRate_Mode",
        "BitRate_Mode_String",
        "BitRate",
        "BitRate_Minimum",
        "BitRate_Nominal",
        "BitRate_Maximum",
        "Channels",
        "Channels_String",
        "ChannelPositions",
        "ChannelLayout",
        "SamplesPerFrame",
        "SamplingRate",
        "SamplingRate_String",
        "SamplingCount",
        "FrameRate",
        "FrameCount",
        "Source_FrameCount",
        "BitDepth",
        "BitDepth_String",
        "Compression_Mode",
        "StreamSize",
        "StreamSize_String",
        "Source_StreamSize",
        "Delay",
        "Delay_Source",
        "Encoded_Library",
        "Encoded_Library_String",
        "Title",
        "Language",
        "Default",
        "Forced",
        "AlternateGroup",
        "ServiceKind",
    ),
    "Image": (
        "Count",
        "StreamCount",
        "StreamKind",
        "StreamKindID",
        "StreamKindPos",
        "ID",
        "Type",
        "Format",
        "Format_Profile",
        "Format_Version",
        "Format_Compression",
        "Format_Settings_Packing",
        "Format_Settings_Endianness",
        "Width",
        "Height",
        "PixelAspectRatio",
        "DisplayAspectRatio",
        "ColorSpace",
        "ChromaSubsampling",
        "BitDepth",
        "Compression_Mode",
        "StreamSize",
    ),
    "Video": (
        "Count",
        "StreamCount",
        "StreamKind",
        "StreamKindID",
        "StreamKindPos",
        "StreamOrder",
        "ID",
        "UniqueID",
        "Format",
        "Format_String",
        "Format_Info",
        "Format_Url",
        "Format_Commercial",
        "Format_Commercial_IfAny",
        "Format_Profile",
        "Format_Level",
        "Format_Tier",
        "Format_Settings",
        "Format_Settings_CABAC",
        "Format_Settings_RefFrames",
        "Format_Settings_GOP",
        "Format_Settings_BVOP",
        "Format_Settings_QPel",
        "Format_Settings_GMC",
        "Format_Settings_Matrix",
        "Format_Version",
        "MuxingMode",
        "CodecID",
        "CodecID_String",
        "CodecID_Info",
        "CodecID_Hint",
        "CodecID_Url",
        "Duration",
        "BitRate_Mode",
        "BitRate",
        "BitRate_Nominal",
        "BitRate_Maximum",
        "Width",
        "Height",
        "Stored_Width",
        "Stored_Height",
        "Sampled_Width",
        "Sampled_Height",
        "PixelAspectRatio",
        "DisplayAspectRatio",
        "Rotation",
        "FrameRate_Mode",
        "FrameRate_Mode_Original",
        "FrameRate",
        "FrameRate_Num",
        "FrameRate_Den",
        "FrameCount",
        "Standard",
        "ColorSpace",
        "ChromaSubsampling",
        "BitDepth",
        "ScanType",
        "ScanOrder",
        "Compression_Mode",
        "Delay",
        "Delay_Source",
        "StreamSize",
        "Source_StreamSize",
        "Encoded_Library",
        "Encoded_Library_Name",
        "Encoded_Library_Version",
        "Encoded_Library_Settings",
        "Language",
        "Default",
        "Forced",
        "colour_description_present",
        "colour_description_present_Source",
        "colour_range",
        "colour_range_Source",
        "colour_primaries",
        "colour_primaries_Source",
        "transfer_characteristics",
        "transfer_characteristics_Source",
        "matrix_coefficients",
        "matrix_coefficients_Source",
        "HDR_Format",
        "HDR_Format_Version",
        "HDR_Format_Profile",
        "HDR_Format_Level",
        "HDR_Format_Settings",
        "HDR_Format_Compatibility",
    ),
}

# Fields that go to the extra part, by kind of stream.
EXTRA: dict[str, tuple[str, ...]] = {
    "General": (
        "ErrorDetectionType",
    ),
    "Audio": (
        "MD5_Unencoded",
        "bsid",
        "dialnorm",
        "dsurmod",
        "acmod",
        "lfeon",
        "dialnorm_Average",
        "dialnorm_Minimum",
        "Source_Delay",
        "Source_Delay_Source",
    ),
    "Image": (
        "FrameRate",
        "DPI",
        "Density_X",
        "Density_Y",
        "Density_Unit",
        "Density_String",
    ),
    "Video": (
        "CodecConfigurationBox",
    ),
}

# Fields that the text report shows, in order, by kind of stream.
SHOWN: dict[str, tuple[str, ...]] = {
    "General": (
        "CompleteName",
        "Format",
        "Format_Version",
        "CodecID",
        "FileSize",
        "Duration",
        "OverallBitRate",
        "FrameRate",
        "IsComplete",
        "Encoded_Application",
        "Encoded_Library",
        "Encoded_Date",
        "Tagged_Date",
        "Comment",
    ),
    "Video": (
        "ID",
        "Format",
        "Format_Info",
        "Format_Profile",
        "Format_Settings_CABAC",
        "Format_Settings_RefFrames",
        "Format_Settings_GOP",
        "Format_Settings_SliceCount",
        "CodecID",
        "Duration",
        "BitRate",
        "Width",
        "Height",
        "DisplayAspectRatio",
        "FrameRate_Mode",
        "FrameRate",
        "ColorSpace",
        "ChromaSubsampling",
        "BitDepth",
        "ScanType",
        "Bits_Pixel_Frame",
        "StreamSize",
        "Encoded_Library",
        "Encoded_Library_Settings",
        "Title",
        "Language",
        "Default",
        "Forced",
        "Encoded_Date",
        "Tagged_Date",
        "colour_range",
        "colour_primaries",
        "transfer_characteristics",
        "matrix_coefficients",
        "CodecConfigurationBox",
        "Format_Level_Inferred",
    ),
    "Audio": (
        "ID",
        "Format",
        "Format_Info",
        "Format_Version",
        "Format_Profile",
        "Format_Settings_Mode",
        "CodecID",
        "Duration",
        "Source_Duration",
        "BitRate_Mode",
        "BitRate",
        "BitRate_Maximum",
        "Channels",
        "ChannelLayout",
        "SamplingRate",
        "BitDepth",
        "FrameRate",
        "Compression_Mode",
        "Delay",
        "StreamSize",
        "Source_StreamSize",
        "Title",
        "Language",
        "Default",
        "Forced",
        "Encoded_Library",
        "Encoded_Date",
        "Tagged_Date",
    ),
    "Other": (
        "ID",
        "Type",
        "Format",
        "CodecID",
        "Duration",
        "Source_Duration",
        "BitRate_Mode",
        "FrameCount",
        "StreamSize",
        "Source_StreamSize",
        "Title",
        "Language",
        "Default",
        "Encoded_Date",
        "Tagged_Date",
    ),
    "Image": (
        "ID",
        "Type",
        "Format",
        "Format_Profile",
        "Width",
        "Height",
        "ColorSpace",
        "ChromaSubsampling",
        "BitDepth",
        "Compression_Mode",
        "StreamSize",
    ),
    "Exif": (
        "Recorded_Date",
        "Mastered_Date",
        "Encoded_Hardware_CompanyName",
        "Encoded_Hardware_Model",
        "Make",
        "Model",
        "Software",
        "DateTime",
        "DateTimeOriginal",
        "DateTimeDigitized",
        "ImageDescription",
        "Artist",
        "Copyright",
        "ExposureTime",
        "FNumber",
        "PhotographicSensitivity",
        "ISOSpeed",
        "ExposureProgram",
        "MeteringMode",
        "Flash",
        "FocalLength",
        "FocalLengthIn35mmFilm",
        "LensModel",
        "LensMake",
        "ShutterSpeedValue",
        "ApertureValue",
        "ExposureBiasValue",
        "WhiteBalance",
        "ColorSpace",
        "GPSLatitudeRef",
        "GPSLatitude",
        "GPSLongitudeRef",
        "GPSLongitude",
        "GPSAltitudeRef",
        "GPSAltitude",
        "GPSSpeedRef",
        "GPSSpeed",
        "GPSImgDirectionRef",
        "GPSImgDirection",
        "GPSDestBearingRef",
        "GPSDestBearing",
        "GPSHPositioningError",
        "GPSLatitudeDecimal",
        "GPSLongitudeDecimal",
        "Orientation",
        "ScaleFactor35efl",
        "CircleOfConfusion",
        "FieldOfView",
        "HyperfocalDistance",
        "LightValue",
        "MakerNoteVersion",
        "AEStable",
        "AETarget",
        "AEAverage",
        "AFStable",
        "AccelerationVector",
        "FocusDistanceRange",
        "ContentIdentifier",
        "ImageCaptureType",
        "LivePhotoVideoIndex",
        "PhotosAppFeatureFlags",
        "HDRHeadroom",
        "SignalToNoiseRatio",
        "PhotoIdentifier",
        "ColorTemperature",
        "CameraType",
        "FocusPosition",
    ),
    "Iptc": (
        "ObjectName",
        "Byline",
        "BylineTitle",
        "Headline",
        "Caption",
        "CaptionWriter",
        "Category",
        "City",
        "ProvinceState",
        "Country",
        "CountryCode",
        "Keywords",
        "Description",
        "Credit",
        "Source",
        "Copyright",
        "Contact",
        "OriginatingProgram",
        "DateCreated",
        "TimeCreated",
        "Urgency",
        "ServiceIdentifier",
    ),
}
