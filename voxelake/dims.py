"""Fixed dictionaries: tags, rules, syntaxes, character sets, requirements, status codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: keyword, tag, value representation of files, value representation of JSON ("-": not listed, so UN)
TAG_TEXT = """
MediaStorageSOPClassUID 00020002 UI -
MediaStorageSOPInstanceUID 00020003 UI -
TransferSyntaxUID 00020010 UI -
ImplementationClassUID 00020012 UI -
SpecificCharacterSet 00080005 CS -
ImageType 00080008 CS -
SOPClassUID 00080016 UI UI
SOPInstanceUID 00080018 UI UI
StudyDate 00080020 DA DA
SeriesDate 00080021 DA DA
AcquisitionDate 00080022 DA DA
ContentDate 00080023 DA DA
AcquisitionDateTime 0008002A DT -
StudyTime 00080030 TM TM
SeriesTime 00080031 TM TM
AcquisitionTime 00080032 TM TM
ContentTime 00080033 TM TM
AccessionNumber 00080050 SH SH
Modality 00080060 CS CS
Manufacturer 00080070 LO -
InstitutionName 00080080 LO LO
InstitutionAddress 00080081 ST -
ReferringPhysicianName 00080090 PN PN
StationName 00081010 SH -
StudyDescription 00081030 LO -
SeriesDescription 0008103E LO -
InstitutionalDepartmentName 00081040 LO -
AttendingPhysicianName 00081048 PN -
PerformingPhysicianName 00081050 PN -
OperatorsName 00081070 PN -
AdmittingDiagnosesDescription 00081080 LT -
ManufacturerModelName 00081090 LO -
ReferencedStudySequence 00081110 SQ -
ReferencedSeriesSequence 00081115 SQ -
ReferencedSOPClassUID 00081150 UI -
ReferencedSOPInstanceUID 00081155 UI -
PatientName 00100010 PN PN
PatientID 00100020 LO LO
PatientBirthDate 00100030 DA DA
PatientSex 00100040 CS CS
OtherPatientIDs 00101000 LO -
PatientAge 00101010 AS -
PatientSize 00101020 DS -
PatientWeight 00101030 DS -
PatientAddress 00101040 LO -
MedicalAlerts 00102000 LO -
Allergies 00102110 LO -
PatientTelephoneNumbers 00102154 SH -
EthnicGroup 00102160 SH -
SmokingStatus 001021A0 CS -
PregnancyStatus 001021C0 US -
PatientComments 00104000 LT -
PatientIdentityRemoved 00120062 CS -
DeidentificationMethod 00120063 LO -
BodyPartExamined 00180015 CS -
ScanningSequence 00180020 - -
SequenceVariant 00180021 - -
SliceThickness 00180050 DS -
KVP 00180060 - -
SpacingBetweenSlices 00180088 DS -
DeviceSerialNumber 00181000 LO -
SoftwareVersions 00181020 LO -
ProtocolName 00181030 LO -
ImagerPixelSpacing 00181164 DS -
PatientPosition 00185100 CS -
ViewPosition 00185101 CS -
StudyInstanceUID 0020000D UI UI
SeriesInstanceUID 0020000E UI UI
StudyID 00200010 SH SH
SeriesNumber 00200011 IS -
AcquisitionNumber 00200012 IS -
InstanceNumber 00200013 IS -
ImagePositionPatient 00200032 DS -
ImageOrientationPatient 00200037 DS -
FrameOfReferenceUID 00200052 UI -
SliceLocation 00201041 DS -
SamplesPerPixel 00280002 US -
PhotometricInterpretation 00280004 CS -
PlanarConfiguration 00280006 US -
NumberOfFrames 00280008 IS -
Rows 00280010 US US
Columns 00280011 US US
PixelSpacing 00280030 DS -
BitsAllocated 00280100 US US
BitsStored 00280101 US US
HighBit 00280102 US US
PixelRepresentation 00280103 US US
SmallestImagePixelValue 00280106 US -
LargestImagePixelValue 00280107 US -
BurnedInAnnotation 00280301 CS -
LongitudinalTemporalInformationModified 00280303 CS -
WindowCenter 00281050 DS -
WindowWidth 00281051 DS -
RescaleIntercept 00281052 DS -
RescaleSlope 00281053 DS -
RescaleType 00281054 LO -
RequestingPhysician 00321032 PN -
RequestedProcedureDescription 00321070 LO -
PixelData 7FE00010 OB/OW OB
"""
TAGS = [tuple(line.split()) for line in TAG_TEXT.strip().splitlines()]
TAG_OF = {keyword: tag for keyword, tag, _, _ in TAGS}
KEYWORD_OF = {tag: keyword for keyword, tag, _, _ in TAGS}
FILE_VR = {tag: vr for _, tag, vr, _ in TAGS if vr != "-"}
JSON_VR = {tag: vr for _, tag, _, vr in TAGS if vr != "-"}

# fixed values: the starter profile's actions, in order; the UID tags follow
STARTER_TEXT = """
PatientName REPLACE Anonymous
PatientID REPLACE ANON
PatientBirthDate EMPTY
PatientSex EMPTY
PatientAddress DELETE
PatientTelephoneNumbers DELETE
OtherPatientIDs DELETE
PatientAge EMPTY
PatientWeight DELETE
PatientSize DELETE
PatientComments DELETE
EthnicGroup DELETE
PregnancyStatus DELETE
SmokingStatus DELETE
MedicalAlerts DELETE
Allergies DELETE
AdmittingDiagnosesDescription DELETE
AccessionNumber EMPTY
StudyDate EMPTY
SeriesDate EMPTY
AcquisitionDate EMPTY
ContentDate EMPTY
AcquisitionDateTime EMPTY
StudyTime EMPTY
SeriesTime EMPTY
AcquisitionTime EMPTY
ContentTime EMPTY
InstitutionName EMPTY
InstitutionAddress DELETE
InstitutionalDepartmentName DELETE
ReferringPhysicianName EMPTY
PerformingPhysicianName EMPTY
OperatorsName EMPTY
AttendingPhysicianName EMPTY
RequestingPhysician DELETE
RequestedProcedureDescription EMPTY
StationName EMPTY
DeviceSerialNumber DELETE
StudyID EMPTY
LongitudinalTemporalInformationModified REPLACE REMOVED
PatientIdentityRemoved REPLACE YES
DeidentificationMethod REPLACE
StudyInstanceUID REMAP_UID
SeriesInstanceUID REMAP_UID
SOPInstanceUID REMAP_UID
FrameOfReferenceUID REMAP_UID
MediaStorageSOPInstanceUID REMAP_UID
ReferencedSOPInstanceUID REMAP_UID
"""
METHOD = "voxelake starter profile"
STARTER = [
    (TAG_OF[name], action, METHOD if name == "DeidentificationMethod" else (rest[0] if rest else None))
    for name, action, *rest in (line.split(" ", 2) for line in STARTER_TEXT.strip().splitlines())
]
# fixed values: markers that a replacement sets even where they are absent
MARKERS = [TAG_OF[k] for k in ("LongitudinalTemporalInformationModified", "PatientIdentityRemoved", "DeidentificationMethod")]

# fixed values: transfer syntaxes: uid, name, little endian, explicit VR, encapsulated
TRANSFER_SYNTAXES = [
    ("1.2.840.10008.1.2", "Implicit VR Little Endian", True, False, False),
    ("1.2.840.10008.1.2.1", "Explicit VR Little Endian", True, True, False),
    ("1.2.840.10008.1.2.1.99", "Deflated Explicit VR Little Endian", True, True, False),
    ("1.2.840.10008.1.2.2", "Explicit VR Big Endian", False, True, False),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline Process 1", True, True, True),
    ("1.2.840.10008.1.2.4.70", "JPEG Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Lossless", True, True, True),
    ("1.2.840.10008.1.2.5", "RLE Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended Process 2 and 4", True, True, True),
    ("1.2.840.10008.1.2.4.81", "JPEG-LS Near-Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000 (Lossy or Lossless)", True, True, True),
    ("1.2.840.10008.1.2.4.201", "High-Throughput JPEG 2000 Lossless", True, True, True),
    ("1.2.840.10008.1.2.4.202", "High-Throughput JPEG 2000", True, True, True),
]

NATIVE_SYNTAXES = [u for u, _, _, _, encapsulated in TRANSFER_SYNTAXES if not encapsulated]
EXPLICIT_LITTLE = "1.2.840.10008.1.2.1"
NATIVE_CODECS = [("native-uncompressed", 0, uid, True, True) for uid in NATIVE_SYNTAXES]

# fixed values: SOP classes
SOP_TEXT = """
Verification 1.2.840.10008.1.1
StudyRootQueryRetrieveInformationModelFind 1.2.840.10008.5.1.4.1.2.2.1
StudyRootQueryRetrieveInformationModelMove 1.2.840.10008.5.1.4.1.2.2.2
StudyRootQueryRetrieveInformationModelGet 1.2.840.10008.5.1.4.1.2.2.3
PatientRootQueryRetrieveInformationModelFind 1.2.840.10008.5.1.4.1.2.1.1
PatientRootQueryRetrieveInformationModelMove 1.2.840.10008.5.1.4.1.2.1.2
PatientRootQueryRetrieveInformationModelGet 1.2.840.10008.5.1.4.1.2.1.3
CTImageStorage 1.2.840.10008.5.1.4.1.1.2
EnhancedCTImageStorage 1.2.840.10008.5.1.4.1.1.2.1
MRImageStorage 1.2.840.10008.5.1.4.1.1.4
EnhancedMRImageStorage 1.2.840.10008.5.1.4.1.1.4.1
MRSpectroscopyStorage 1.2.840.10008.5.1.4.1.1.4.2
UltrasoundImageStorage 1.2.840.10008.5.1.4.1.1.6.1
UltrasoundMultiFrameImageStorage 1.2.840.10008.5.1.4.1.1.3.1
SecondaryCaptureImageStorage 1.2.840.10008.5.1.4.1.1.7
MultiFrameGrayscaleByteSecondaryCaptureImageStorage 1.2.840.10008.5.1.4.1.1.7.2
MultiFrameGrayscaleWordSecondaryCaptureImageStorage 1.2.840.10008.5.1.4.1.1.7.3
MultiFrameTrueColorSecondaryCaptureImageStorage 1.2.840.10008.5.1.4.1.1.7.4
NuclearMedicineImageStorage 1.2.840.10008.5.1.4.1.1.20
PositronEmissionTomographyImageStorage 1.2.840.10008.5.1.4.1.1.128
EnhancedPETImageStorage 1.2.840.10008.5.1.4.1.1.130
DigitalXRayImageStorageForPresentation 1.2.840.10008.5.1.4.1.1.1.1
DigitalXRayImageStorageForProcessing 1.2.840.10008.5.1.4.1.1.1.1.1
DigitalMammographyXRayImageStorageForPresentation 1.2.840.10008.5.1.4.1.1.1.2
XRayRadiofluoroscopicImageStorage 1.2.840.10008.5.1.4.1.1.12.2
XRay3DAngiographicImageStorage 1.2.840.10008.5.1.4.1.1.13.1.1
CRImageStorage 1.2.840.10008.5.1.4.1.1.1
RTImageStorage 1.2.840.10008.5.1.4.1.1.481.1
RTDoseStorage 1.2.840.10008.5.1.4.1.1.481.2
RTStructureSetStorage 1.2.840.10008.5.1.4.1.1.481.3
RTBeamsTreatmentRecordStorage 1.2.840.10008.5.1.4.1.1.481.4
VLWholeSlideMicroscopyImageStorage 1.2.840.10008.5.1.4.1.1.77.1.6
BasicTextSRStorage 1.2.840.10008.5.1.4.1.1.88.11
EnhancedSRStorage 1.2.840.10008.5.1.4.1.1.88.22
ComprehensiveSRStorage 1.2.840.10008.5.1.4.1.1.88.33
MammographyCADSRStorage 1.2.840.10008.5.1.4.1.1.88.50
KeyObjectSelectionDocumentStorage 1.2.840.10008.5.1.4.1.1.88.59
"""
SOP_CLASSES = [tuple(line.split()) for line in SOP_TEXT.strip().splitlines()]

# fixed values: defined terms of the specific character set and their codecs; the empty term is the default
CHARSETS = {
    "": "ascii", "ISO_IR 6": "ascii", "ISO 2022 IR 6": "ascii", "ISO_IR 100": "latin_1", "ISO_IR 101": "iso8859_2",
    "ISO_IR 109": "iso8859_3", "ISO_IR 110": "iso8859_4", "ISO_IR 144": "iso8859_5", "ISO_IR 127": "iso8859_6",
    "ISO_IR 126": "iso8859_7", "ISO_IR 138": "iso8859_8", "ISO_IR 148": "iso8859_9", "ISO_IR 166": "iso8859_11",
    "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk", "ISO 2022 IR 87": "iso2022_jp", "ISO 2022 IR 149": "iso2022_kr",
}
# fixed values: names of encodings and the term preferred for each
PREFERRED_CHARSET = {
    "ascii": "ISO_IR 6", "us-ascii": "ISO_IR 6", "latin_1": "ISO_IR 100", "latin-1": "ISO_IR 100", "iso8859_1": "ISO_IR 100",
    "iso-8859-1": "ISO_IR 100", "utf-8": "ISO_IR 192", "utf8": "ISO_IR 192", "gb18030": "GB18030", "gbk": "GBK",
    "iso2022_jp": "ISO 2022 IR 87", "iso-2022-jp": "ISO 2022 IR 87", "iso2022_kr": "ISO 2022 IR 149", "iso-2022-kr": "ISO 2022 IR 149",
}
# fixed values: photometric interpretations and their samples per pixel
SAMPLES = {
    "MONOCHROME1": 1, "MONOCHROME2": 1, "PALETTE COLOR": 1, "RGB": 3, "YBR_FULL": 3, "YBR_FULL_422": 3,
    "YBR_PARTIAL_422": 3, "YBR_ICT": 3, "YBR_RCT": 3,
}
# fixed values: DIMSE status codes
STATUS = {
    "Success": 0x0000, "Pending": 0xFF00, "Cancel": 0xFE00, "UnableToProcess": 0xC000, "OutOfResources": 0xA700,
    "IdentifierDoesNotMatchSOPClass": 0xA900, "DataSetDoesNotMatchSOPClass": 0xA101, "CannotUnderstand": 0xC000,
}

# fixed values: mandatory attributes, by SOP class
COMMON_1 = """SOPClassUID SOPInstanceUID StudyInstanceUID SeriesInstanceUID Modality SamplesPerPixel PhotometricInterpretation
Rows Columns BitsAllocated BitsStored HighBit PixelRepresentation PixelData""".split()
COMMON_2 = "PatientName PatientID StudyDate StudyTime StudyID AccessionNumber SeriesNumber InstanceNumber".split()
IOD_PROFILES = {
    "1.2.840.10008.5.1.4.1.1.2": ("CT Image Storage", COMMON_1 + ["ImageType", "RescaleIntercept", "RescaleSlope"], COMMON_2 + ["KVP", "AcquisitionNumber"]),
    "1.2.840.10008.5.1.4.1.1.4": ("MR Image Storage", COMMON_1 + ["ImageType", "ScanningSequence", "SequenceVariant"], COMMON_2),
    "1.2.840.10008.5.1.4.1.1.6.1": ("Ultrasound Image Storage", COMMON_1, COMMON_2),
    "1.2.840.10008.5.1.4.1.1.1": ("CR Image Storage", COMMON_1 + ["ImageType"], COMMON_2 + ["BodyPartExamined"]),
    "1.2.840.10008.5.1.4.1.1.7": ("Secondary Capture Image Storage", COMMON_1[:4], COMMON_2),
}
IOD_ROWS = [
    (uid, name, kind, seq, TAG_OF[keyword], keyword)
    for uid, (name, one, two) in IOD_PROFILES.items()
    for kind, keywords in ((1, one), (2, two))
    for seq, keyword in enumerate(keywords)
]


def dim_tags(spark: SparkSession) -> DataFrame:
    rows = [(k, t, None if v == "-" else v, None if j == "-" else j) for k, t, v, j in TAGS]
    return spark.createDataFrame(rows, "keyword string, tag8 string, file_vr string, json_vr string")


def dim_transfer_syntaxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSFER_SYNTAXES, "uid string, name string, little_endian boolean, explicit_vr boolean, encapsulated boolean")


def dim_codecs(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """(name, priority, syntax_uid, can_decode, can_encode); ``more`` rows of other codecs follow the native one."""
    return spark.createDataFrame(NATIVE_CODECS + list(more), "codec_name string, priority int, syntax_uid string, can_decode boolean, can_encode boolean")


def dim_iod(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IOD_ROWS, "sop_class_uid string, profile string, type int, seq int, tag8 string, label string")


def dim_sop_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOP_CLASSES, "name string, uid string")


def dim_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATUS.items()), "name string, code int")
